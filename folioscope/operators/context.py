"""Context windows and ordered folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.functions import text as T
from folioscope.plans import greedy


def budgeted(rows: Column, length, most_rows: int, budget: int) -> Column:
    """Take rows in order while they fit; the first is always taken, the first that does not fit ends it."""
    zero = F.struct(F.lit(0).cast("bigint").alias("chars"), F.lit(0).alias("n"), F.lit(False).alias("done"))

    def step(a, x):
        fits = ~a["done"] & (a["n"] < most_rows) & ((a["n"] == 0) | (a["chars"] + length(x) <= budget))
        return F.struct((a["chars"] + F.when(fits, length(x)).otherwise(0)).cast("bigint").alias("chars"), (a["n"] + F.when(fits, 1).otherwise(0)).cast("int").alias("n"), (a["done"] | ~fits).alias("done"))

    n = F.aggregate(rows, zero, step, lambda a: a["n"])
    return F.slice(rows, F.lit(1), n)


def previous(segments: DataFrame, group: str, idx: str, text: str, most: int = 3, budget: int = 400, reach: int = 4, only: Column | None = None) -> DataFrame:
    """Each segment with the nearest earlier ones of its group, within ``reach * most`` places and ``budget`` characters."""
    ok = T.jtrim(F.col(text)) != ""
    if only is not None:
        ok = ok & only
    item = F.when(ok, F.struct((-F.col(idx)).alias("o"), F.col(idx).alias("idx"), T.jtrim(F.col(text)).alias("t")))
    w = W.partitionBy(group).orderBy(idx).rangeBetween(-reach * most, -1)
    near = F.array_sort(F.collect_list(item).over(w))
    return segments.withColumn("context", budgeted(near, lambda x: F.length(x["t"]), most, budget))


def chunks(rows: DataFrame, group: str, idx: str, text: str, budget: int) -> DataFrame:
    """Greedy packing in order: ``(group, chunk, n, tokens)``; a row that does not fit opens the next chunk."""
    r = greedy.chunked(rows, group, idx, T.rough_tokens(F.col(text)), budget)
    return r.groupBy(group, F.col("chunk").cast("int").alias("chunk")).agg(F.count(F.lit(1)).cast("int").alias("n"), F.sum("tokens").alias("tokens"))


def spread(rows: DataFrame, group: str, idx: str, head: int = 5, middle: int = 3, tail: int = 2) -> DataFrame:
    """Sample of each group: its head, evenly spaced middle rows and its tail, as ``part``."""
    w = W.partitionBy(group)
    r = rows.withColumn("_p", F.row_number().over(w.orderBy(idx)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    zone = F.col("_n") - head - tail
    step = F.floor(zone / (middle + 1))
    at = F.col("_p") - head + 1
    mid = (zone > 0) & (step > 0) & (at > 0) & (at <= zone) & (at % F.greatest(step, F.lit(1)) == 0) & (at / F.greatest(step, F.lit(1)) <= middle)
    part = F.when(F.col("_p") < head, "head").when(F.col("_p") >= F.col("_n") - tail, "tail").when(mid, "middle")
    return r.withColumn("part", part).where("part is not null").drop("_p", "_n")


def sliding_failures(rows: DataFrame, group: str, seq: str, failed: Column, window: int = 100, least: int = 10) -> DataFrame:
    """Failures among the last ``window`` rows and whether the breaker trips there."""
    w = W.partitionBy(group).orderBy(seq).rowsBetween(-(max(window, least) - 1), 0)
    r = rows.withColumn("fails", F.sum(failed.cast("int")).over(w)).withColumn("seen", F.count(F.lit(1)).over(w))
    return r.withColumn("tripped", (F.col("seen") >= least) & (F.col("fails") >= least))


def within_budget(rows: DataFrame, group: str, seq: str, cost: str, budget: float) -> DataFrame:
    """Rows up to and including the first whose running cost exceeds the budget."""
    w = W.partitionBy(group).orderBy(seq).rowsBetween(W.unboundedPreceding, 0)
    r = rows.withColumn("spent", F.sum(cost).over(w)).withColumn("_before", F.coalesce(F.max("spent").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    return r.where(F.col("_before") <= budget).drop("_before")


def streaks(rows: DataFrame, group: str, seq: str, failed: Column, least: int = 3) -> DataFrame:
    """Runs of ``least`` or more failures: ``(group, first_seq, n)``."""
    w = W.partitionBy(group).orderBy(seq)
    r = rows.withColumn("_f", failed).withColumn("_a", F.row_number().over(w)).withColumn("_b", F.row_number().over(W.partitionBy(group, "_f").orderBy(seq)))
    return r.where("_f").groupBy(group, (F.col("_a") - F.col("_b")).alias("_g")).agg(F.min(seq).alias("first_seq"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("_g")


def concurrency(configured: Column, remaining: Column) -> Column:
    return F.least(configured, F.greatest(F.lit(1), F.floor(remaining / 2))).cast("int")
