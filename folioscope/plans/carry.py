"""The row before each row of a key, where a key may hold a large share of all rows.

Rows are dealt to ranges of their order, whose borders are quantiles of all
rows. A window inside each (key, range) finds the row before; the first row of
a range takes the last one of the nearest earlier range that has its key, from
a table with one row a key and range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def before(df: DataFrame, keys: list[str], order: str, columns: list[str], out: str, ranges: int | None = None) -> DataFrame:
    """``df`` with ``out``: a struct of ``columns`` of the row before in ``order`` (a number, unique in a key), null for the first."""
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = sorted(set(df.approxQuantile(order, [k / n for k in range(1, n)], 0.001))) if n > 1 else []
    at = F.lit(0)
    if borders:
        at = F.size(F.filter(F.array(*map(F.lit, borders)), lambda b: b < F.col(order)))
    item = F.struct(*columns)
    d = df.withColumn("_range", at)
    last = d.groupBy(*keys, "_range").agg(F.max_by(item, F.col(order)).alias("_last"))
    last = last.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)), F.col("_range").alias("_r"), F.lag("_last").over(W.partitionBy(*keys).orderBy("_range")).alias("_carried"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    inside = F.lag(item).over(W.partitionBy(*keys, "_range").orderBy(order))
    d = d.withColumn(out, inside).join(last.where("_carried is not null"), same, "left")
    return d.select(*df.columns, F.coalesce(F.col(out), F.col("_carried")).alias(out))
