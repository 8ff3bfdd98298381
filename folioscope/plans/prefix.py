"""Running totals within keys whose groups may hold a large share of all rows.

Rows are dealt to about sqrt(n) chunks by a hash of their order columns. A
window inside each (key, chunk) and one over the chunk sums of a key then give
the total before every row, and neither window sees more than about sqrt(n)
rows of a key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def chunks_for(n_rows: int) -> int:
    return max(1, math.isqrt(max(0, n_rows - 1)) + 1)


def exclusive_total(df: DataFrame, key: str, order: list[str], value: Column, n_rows: int, out: str) -> DataFrame:
    """``df`` with ``out``: the sum of ``value`` over the rows of the same key that come before (any fixed order)."""
    d = df.withColumn("_pv", value.cast("bigint")).withColumn("_pc", F.pmod(F.xxhash64(*order), F.lit(chunks_for(n_rows))).cast("int"))
    sums = d.groupBy(key, "_pc").agg(F.sum("_pv").alias("_ps"))
    before = W.partitionBy(key).orderBy("_pc").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("_pk"), F.col("_pc").alias("_pd"), F.coalesce(F.sum("_ps").over(before), F.lit(0)).alias("_po"))
    inside = W.partitionBy(key, "_pc").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("_pi", F.coalesce(F.sum("_pv").over(inside), F.lit(0)))
    d = d.join(sums, (d[key].eqNullSafe(sums["_pk"])) & (d["_pc"] == sums["_pd"]))
    return d.withColumn(out, F.col("_po") + F.col("_pi")).drop("_pv", "_pc", "_ps", "_pk", "_pd", "_po", "_pi")
