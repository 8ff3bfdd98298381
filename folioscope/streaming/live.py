"""Live views over the append-only event log.

A view is kept as a table of changes: each micro-batch writes the rows that
changed into a folder of its own number, so a batch that is run again after a
failure replaces what it wrote before, and the last row of a key is what holds.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.plans.staging import shared_dir

#: What a segment of a run can end as, and the markers that steer a run.
OUTCOMES = ["translated", "cached", "flagged", "failed"]
PAUSED, RESUMED, CANCELLED = "paused", "resumed", "cancelled"


def events(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """The log as a stream; ``files_per_trigger`` holds back a burst."""
    r = spark.readStream.schema(schema)
    if files_per_trigger:
        r = r.option("maxFilesPerTrigger", files_per_trigger)
    return r.parquet(path)


def kind_totals(log: DataFrame) -> DataFrame:
    """Count and sum by kind, for complete or update mode."""
    return log.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def timed(log: DataFrame, ts: str) -> DataFrame:
    """Event time as a timestamp, which watermarks need."""
    return log.withColumn(ts, F.col(ts).cast("timestamp"))


def once(log: DataFrame, keys: list[str], ts: str = "ts", within: str = "1 hour") -> DataFrame:
    """Each key once within ``within`` of event time, as for requests in flight; older keys leave the state."""
    return timed(log, ts).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def breaker(log: DataFrame, group: str, seq: str, failed: Column, window: int = 100, least: int = 10) -> DataFrame:
    """For each micro-batch and group: rows seen, failures among the last ``window`` rows, and whether the breaker has tripped."""
    kind = dict(log.dtypes)[group]

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, tripped = state.get if state.exists else ([], 0, False)
        last = list(last)
        rows = pd.concat(list(frames)).sort_values("seq")
        for f in rows["failed"]:
            last = [*last, int(f)][-max(window, least) :]
            seen += 1
            tripped = tripped or (len(last) >= least and sum(last) >= least)
        state.update((last, seen, tripped))
        yield pd.DataFrame({group: [key[0]], "seen": [seen], "fails": [sum(last)], "tripped": [tripped]})

    rows = log.select(group, F.col(seq).alias("seq"), failed.cast("int").alias("failed"))
    return rows.groupBy(group).applyInPandasWithState(step, f"{group} {kind}, seen bigint, fails bigint, tripped boolean", "last array<int>, seen bigint, tripped boolean", "update", GroupStateTimeout.NoTimeout)


def windowed(log: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Extension: totals by event-time window, late rows dropped past the watermark."""
    return timed(log, "ts").withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"))


def to_memory(df: DataFrame, name: str, mode: str, checkpoint: str) -> StreamingQuery:
    return df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def inbox(log: DataFrame, key: str, seq: str, status: str, note: str) -> DataFrame:
    """Flagged rows with the note of their latest flag, as changes ``(key, seq, shown, note)``; a row that is no longer flagged is withdrawn.

    A log row sets a status, adds a note, or both; the null one stays as it
    was. What counts is ``seq``, so a row that comes late overrules nothing
    newer. Nothing is said about rows that stay as they were.
    """
    types = dict(log.dtypes)

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, now_at, said, said_at, shown, shown_note = state.get if state.exists else (None, None, None, None, False, None)
        top = now_at if said_at is None else said_at if now_at is None else max(now_at, said_at)
        for pdf in frames:
            for at, st, nt in zip(pdf["seq"], pdf["status"], pdf["note"], strict=True):
                at = int(at)
                top = at if top is None else max(top, at)
                if st is not None and (now_at is None or at > now_at):
                    now, now_at = st, at
                if nt is not None and (said_at is None or at > said_at):
                    said, said_at = nt, at
        here = now == "flagged"
        changed = here != shown or (here and said != shown_note)
        state.update((now, now_at, said, said_at, here, said if here else None))
        if changed:
            yield pd.DataFrame({key: [k[0]], "seq": [top], "shown": [here], "note": pd.Series([said if here else None], dtype=object)})

    rows = log.where(F.col(key).isNotNull() & F.col(seq).isNotNull()).select(key, F.col(seq).cast("bigint").alias("seq"), F.col(status).alias("status"), F.col(note).cast("string").alias("note"))
    return rows.groupBy(key).applyInPandasWithState(step, f"{key} {types[key]}, seq bigint, shown boolean, note string", "now string, now_at bigint, said string, said_at bigint, shown boolean, shown_note string", "update", GroupStateTimeout.NoTimeout)


def runs(log: DataFrame, run: str, seq: str, kind: str, ms: str, baseline: DataFrame | None = None) -> DataFrame:
    """Running totals of batch runs as changes: ``(run, seq, translated, cached, flagged, failed, skipped, elapsed_ms, phase)``.

    Markers in ``kind`` steer a run: what comes while it is paused, or after it
    was cancelled, is skipped; a cancelled run stays so. ``baseline``, one row
    a run with its counts and ``elapsed_ms``, is where a run that was begun
    elsewhere goes on. A log row that is not newer than those counted already,
    as of a file sent twice, is left out.
    """
    types = dict(log.dtypes)
    start = [*OUTCOMES, "elapsed_ms"]

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq", kind="stable")
        if state.exists:
            *counts, skipped, elapsed, phase, last = state.get
        else:
            *counts, elapsed = (int(x) for x in rows.iloc[0][start])
            skipped, phase, last = 0, "running", None
        for at, what, took in zip(rows["seq"], rows["kind"], rows["ms"], strict=True):
            if last is not None and at <= last:
                continue
            last = int(at)
            if what == CANCELLED:
                phase = CANCELLED
            elif what in (PAUSED, RESUMED):
                phase = phase if phase == CANCELLED else PAUSED if what == PAUSED else "running"
            elif what in OUTCOMES:
                if phase == "running":
                    counts[OUTCOMES.index(what)] += 1
                    elapsed += int(took)
                else:
                    skipped += 1
        state.update((*counts, skipped, elapsed, phase, last))
        yield pd.DataFrame([(k[0], last, *counts, skipped, elapsed, phase)], columns=[run, "seq", *OUTCOMES, "skipped", "elapsed_ms", "phase"])

    rows = log.where(F.col(run).isNotNull() & F.col(seq).isNotNull()).select(run, F.col(seq).cast("bigint").alias("seq"), F.col(kind).alias("kind"), F.coalesce(F.col(ms).cast("bigint"), F.lit(0)).alias("ms"))
    if baseline is not None:
        b = baseline.groupBy(F.col(run).alias("_run")).agg(*(F.max(c).alias(c) for c in start))
        rows = rows.join(b, F.col(run) == F.col("_run"), "left").drop("_run")
        rows = rows.select(run, "seq", "kind", "ms", *(F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in start))
    else:
        rows = rows.select("*", *(F.lit(0).cast("bigint").alias(c) for c in start))
    counts = ", ".join(f"{c} bigint" for c in [*OUTCOMES, "skipped", "elapsed_ms"])
    return rows.groupBy(run).applyInPandasWithState(step, f"{run} {types[run]}, seq bigint, {counts}, phase string", f"{counts}, phase string, last bigint", "update", GroupStateTimeout.NoTimeout)


def progress(totals: DataFrame, pending: Column) -> DataFrame:
    """Totals of :func:`runs` with ``done``, ``total`` (done and pending), ``rate`` a second and ``eta_s``; null where nothing was done in no time."""
    done = sum((F.col(c) for c in OUTCOMES[1:]), F.col(OUTCOMES[0]))
    rate = F.when((F.col("elapsed_ms") > 0) & (done > 0), 1000.0 * done / F.col("elapsed_ms"))
    return totals.withColumn("done", done).withColumn("total", done + pending).withColumn("rate", F.round(rate, 6)).withColumn("eta_s", F.round(pending / rate, 6))


def to_changes(df: DataFrame, mode: str, path: str, name: str) -> StreamingQuery:
    """Each micro-batch in a folder of its number, written over if it runs again; resumes where the checkpoint below ``path`` stands, and ends when all that is there is read."""

    def put(rows: DataFrame, n: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/changes/batch={n}")

    return df.writeStream.outputMode(mode).foreachBatch(put).queryName(name).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()


def changes(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All changes written so far, with the number of their ``batch``."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/changes/batch=-1")
    return spark.read.schema(f"{schema}, batch bigint").option("basePath", f"{path}/changes").parquet(f"{path}/changes")


def latest(rows: DataFrame, key: str) -> DataFrame:
    """The row of a key's last change."""
    cols = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*cols), "batch").alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in cols))


def run_through(df: DataFrame, mode: str, key: str) -> DataFrame:
    """The view that a stream has come to when it has read all that is there."""
    spark = df.sparkSession
    name = f"live_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/folioscope/{name}"
    to_changes(df, mode, path, name).awaitTermination()
    return latest(changes(spark, path, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)), key)
