"""Keyed-table mutations as DataFrame rewrites."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Last write wins by ``seq``; new rows beat old ones with the same number."""
    both = base.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return latest(both, keys, [F.desc(seq), F.desc("_new")]).drop("_new")


def patch(base: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Partial update; ``set_<column>`` says whether a change holds, so null is a value too."""
    c = changes.select(F.col(key).alias("_k"), *(F.col(x).alias(f"_v_{x}") for x in columns), *(F.col(f"set_{x}").alias(f"_s_{x}") for x in columns))
    out = base.join(c, base[key] == c["_k"], "left")
    return out.select(*(F.when(F.col(f"_s_{x}"), F.col(f"_v_{x}")).otherwise(base[x]).alias(x) if x in columns else base[x] for x in base.columns))


def delete(base: DataFrame, gone: DataFrame, key: str, gone_key: str | None = None) -> DataFrame:
    """Without the rows whose key is in ``gone``; apply to each dependent table in turn."""
    g = gone.select(F.col(gone_key or key).alias("_gone"))
    return base.join(g, base[key] == g["_gone"], "left_anti")


def replace_set(base: DataFrame, new: DataFrame, owners: DataFrame, owner: str) -> DataFrame:
    """All rows of the named owners give way to the new ones."""
    return delete(base, owners, owner).unionByName(new)


def embedding_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """By (scope, ref_id, model); an existing row keeps its id and creation time."""
    keys = ["scope", "ref_id", "model"]
    o, n = (d.select(*keys, *(F.col(c).alias(f"{p}{c}") for c in d.columns if c not in keys)) for d, p in ((old, "o_"), (new, "n_")))
    rest = [c for c in old.columns if c not in keys]
    pick = {c: F.coalesce(f"o_{c}", f"n_{c}") if c in ("id", "created_at") else F.coalesce(f"n_{c}", f"o_{c}") for c in rest}
    return o.join(n, keys, "full").select(*keys, *(pick[c].alias(c) for c in rest)).select(*old.columns)


def remap(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rewrite a foreign key by ``(old_id, new_id)``; unmapped keys stay."""
    m = ids.select("old_id", "new_id")
    out = df.join(m, df[column] == m["old_id"], "left")
    return out.select(*(F.coalesce("new_id", df[c]).alias(c) if c == column else df[c] for c in df.columns))


def changed(old: DataFrame, new: DataFrame, key: str, columns: list[str], logged: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that differ, and their revision rows (only for changes of ``logged`` columns)."""
    n = new.select(F.col(key).alias("_k"), *(F.col(c).alias(f"n_{c}") for c in columns))
    both = old.join(n, old[key] == n["_k"])
    differs = lambda cols: reduce(lambda a, b: a | b, (~F.col(c).eqNullSafe(F.col(f"n_{c}")) for c in cols))
    rows = both.where(differs(columns))
    revision = rows.where(differs(logged)).select(F.col(key), *(F.col(c).alias(f"old_{c}") for c in logged), *(F.col(f"n_{c}").alias(f"new_{c}") for c in logged))
    return rows.select(key, *(F.col(f"n_{c}").alias(c) for c in columns)), revision


def keep_last(df: DataFrame, order: str, n: int) -> DataFrame:
    """Ring buffer: the last ``n`` rows by ``order``."""
    return df.orderBy(F.desc(order)).limit(n)


def claimable(me: str, now: int, stale_ms: int = 6000) -> Column:
    """Whether a batch that runs may be taken over: it is mine, nobody's, or its heartbeat is too old."""
    return (F.col("status") == "running") & ((F.col("owner") == me) | F.col("owner").isNull() | (F.lit(now) - F.col("heartbeat") > stale_ms))
