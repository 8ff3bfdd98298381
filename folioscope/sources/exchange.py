"""Glossary and project exchange: JSON, CSV and JSONL bundles."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.functions import text as T

ENTRY = "source_term string, target_term string, type string, status string, source_known boolean, gender string, notes string, source_aliases array<string>, target_aliases array<string>"
CSV_COLUMNS = ("source_term", "target_term", "type", "status", "source_known", "gender", "notes", "source_aliases", "target_aliases")
VERSIONS, BUNDLE_VERSION = (1, 2), 2


def normalised(entries: DataFrame) -> DataFrame:
    """Defaults and checks of imported entries; an entry without a source term must say that it is unknown."""
    e = entries.withColumn("source_term", T.nonblank(F.col("source_term"))).withColumn("type", F.coalesce(T.nonblank(F.col("type")), F.lit("term"))).withColumn("status", F.coalesce(T.nonblank(F.col("status")), F.lit("proposed")))
    e = e.withColumn("source_known", F.coalesce("source_known", F.lit(True)))
    for c in ("source_aliases", "target_aliases"):
        e = e.withColumn(c, F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), T.jtrim), lambda x: x != ""))
    bad = F.col("source_term").isNull() & F.col("source_known")
    return e.withColumn("source_known", F.when(bad, F.raise_error(F.lit("an entry without a source term must have source_known = false")).cast("boolean")).otherwise(F.col("source_known")))


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """Entries of snapshot files ``{"version": 1 or 2, "entries": [...]}``."""
    raw = spark.read.schema(f"version int, entries array<struct<{ENTRY.replace(' string', ':string').replace(' boolean', ':boolean').replace(' array', ':array')}>>").option("multiLine", True).json(path)
    bad = ~F.coalesce(F.col("version").isin(*VERSIONS), F.lit(False)) | F.col("entries").isNull()
    raw = raw.withColumn("entries", F.when(bad, F.raise_error(F.lit("unsupported snapshot")).cast(raw.schema["entries"].dataType)).otherwise(F.col("entries")))
    return normalised(raw.select(F.inline("entries")))


def to_json(entries: DataFrame) -> DataFrame:
    """One row with the snapshot text; meant for a glossary, which people edit by hand."""
    item = F.struct(*CSV_COLUMNS)
    order = F.struct(F.coalesce("source_term", F.lit("")).alias("a"), F.col("target_term").alias("b"), item.alias("e"))
    g = entries.agg(F.array_sort(F.collect_list(order)).alias("x"))
    return g.select(F.to_json(F.struct(F.lit(2).alias("version"), F.transform("x", lambda r: r["e"]).alias("entries")), {"ignoreNullFields": "false"}).alias("value"))


def write_json(entries: DataFrame, path: str, most: int = 4_000_000) -> None:
    """Snapshot files of about ``most`` characters at most, in the order of ``to_json``; no task holds more than one of them."""
    item = F.struct(*CSV_COLUMNS)
    order = [F.coalesce("source_term", F.lit("")), F.col("target_term"), item]
    lines = entries.repartitionByRange(*order).sortWithinPartitions(*order).select(F.to_json(item, {"ignoreNullFields": "false"}).alias("value"))

    def run(batches):
        held, room = [], most
        whole = lambda: pd.DataFrame({"value": [f'{{"version":2,"entries":[{",".join(held)}]}}']})
        for pdf in batches:
            for line in pdf["value"]:
                if held and room < len(line):
                    yield whole()
                    held, room = [], most
                held.append(line)
                room -= len(line)
        if held:
            yield whole()

    lines.mapInPandas(run, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Entries from CSV with a header of the nine columns in any order."""
    raw = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True).csv(path)
    missing = [c for c in CSV_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    split = lambda c: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), T.jtrim), lambda x: x != "")
    known = F.lower(F.coalesce("source_known", F.lit(""))).isin("true", "1")
    return normalised(raw.select("source_term", "target_term", "type", "status", known.alias("source_known"), "gender", "notes", split("source_aliases").alias("source_aliases"), split("target_aliases").alias("target_aliases")))


def write_csv(entries: DataFrame, path: str) -> None:
    flat = entries.select(*(F.array_join(c, ";").alias(c) if c.endswith("aliases") else F.col(c).cast("string").alias(c) for c in CSV_COLUMNS))
    flat.write.option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").csv(path)


def export_bundle(tables: dict[str, DataFrame], path: str, project_id: str) -> None:
    """One JSONL folder a table, vectors as base64 of little-endian float32, and a manifest."""
    for name, df in tables.items():
        if "vector" in df.columns:
            df = df.withColumn("vector", F.base64(packed(F.col("vector"))))
        df.write.option("ignoreNullFields", "false").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(BUNDLE_VERSION, project_id, sorted(tables))], "schema_version int, project_id string, tables array<string>").coalesce(1).write.json(f"{path}/manifest")


def import_bundle(spark: SparkSession, path: str, schemas: dict[str, str], project_id: str) -> dict[str, DataFrame]:
    """Tables of a bundle under a new project id; event ids are dropped, missing tables are empty."""
    m = spark.read.schema("schema_version int, project_id string, tables array<string>").json(f"{path}/manifest").first()
    if m is None or m["schema_version"] > BUNDLE_VERSION:
        raise ValueError("unsupported bundle")
    out = {}
    for name, schema in schemas.items():
        if name not in m["tables"]:
            out[name] = spark.createDataFrame([], schema)
            continue
        df = spark.read.schema(schema.replace("vector array<float>", "vector string")).json(f"{path}/{name}")
        if "vector" in df.columns:
            df = df.withColumn("vector", unpacked(F.unbase64("vector")))
        if "project_id" in df.columns:
            df = df.withColumn("project_id", F.lit(project_id))
        out[name] = df.drop("event_id") if name == "events" else df
    return out


def packed(c):
    """float32 array to little-endian bytes."""
    import numpy as np

    def run(s):
        return s.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "binary")(c)


def unpacked(c):
    """Little-endian bytes to a float32 array."""
    import numpy as np

    def run(s):
        return s.map(lambda v: None if v is None else np.frombuffer(v, "<f4"))

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "array<float>")(c)
