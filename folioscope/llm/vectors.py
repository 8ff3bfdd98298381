"""Embedding near-duplicates, exactly, tile against tile.

Equal vectors are collapsed. The others of each length are dealt to tiles by a
hash of their id and every pair of tiles is compared by cosine in double
precision, so no pair is missed however many vectors there are or however
dense they lie. A pair of tiles counts the links of its vectors and gives a
spanning forest of them. Work grows with the square of the distinct vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite
components link with nothing; vectors of different lengths never link; equal
vectors link with each other and are compared once; rows that repeat an id or
have none count as vectors of their own, and a group without ids has a null
component; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from folioscope.llm.common import runs, whole_groups
from folioscope.plans.graph import connected_components, forest
from folioscope.plans.staging import stage

TILE, SPREAD, CHUNK = 32_768, 8, 512  # vectors in a tile at most, tiles at least, rows compared at once


def units(column: pd.Series) -> np.ndarray:
    """Rows scaled to length 1, in double precision."""
    x = np.stack([np.frombuffer(v, "<f8") for v in column])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def tile_links(x: np.ndarray, y: np.ndarray | None, least: float):
    """Yield index arrays (i, j) of the rows of ``x`` that link with rows of ``y``, or with later rows of ``x`` itself."""
    for at in range(0, len(x), CHUNK):
        i, j = np.nonzero(x[at : at + CHUNK] @ (x[at:] if y is None else y).T >= least)
        if y is None:
            later = j > i
            i, j = i[later], j[later] + at
        yield i + at, j


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)``, one row for every input row."""
    v = F.col("v")
    good = F.coalesce(F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))) & F.exists("v", lambda c: c != 0), F.lit(False))
    rows = df.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.withColumn("good", good).select("vec_id", "v", "good", F.when(F.col("good"), F.xxhash64(v)).alias("h1"), F.when(F.col("good"), F.xxhash64(F.lit(1), v)).alias("h2"))
    ids = stage(rows.select("vec_id", "h1", "h2"), "vec-ids")
    reps = rows.where("good").groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("copies"), F.first("v").alias("v"))

    def to_bytes(batches):
        at = TaskContext.get().partitionId() << 40  # a number for each distinct vector, whatever its ids
        for pdf in batches:
            pdf["x"] = [np.asarray(a, "<f8").tobytes() for a in pdf["v"]]
            pdf["rep"] = at + np.arange(len(pdf))
            at += len(pdf)
            yield pdf[["h1", "h2", "rep", "copies", "x"]]

    reps = stage(reps.mapInPandas(to_bytes, "h1 bigint, h2 bigint, rep bigint, copies bigint, x binary"), "vec-reps")

    sized = reps.select("rep", "copies", "x", F.length("x").alias("dim"))
    n = sized.groupBy("dim").agg(F.count(F.lit(1)).alias("size"))
    tiles = F.when(F.col("size") <= CHUNK, 1).otherwise(F.greatest(F.lit(SPREAD), F.ceil(F.col("size") / TILE))).cast("int")
    placed = sized.join(F.broadcast(n), "dim").withColumn("tiles", tiles).withColumn("t", F.pmod(F.xxhash64("rep"), F.col("tiles")).cast("int"))
    placed = placed.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    placed = placed.select("dim", F.least("t", "o").alias("i"), F.greatest("t", "o").alias("j"), "t", "rep", "copies", "x")

    def compare(batches):
        for pdf in whole_groups(batches, ["dim", "i", "j"], 1):
            cut = runs(pdf["dim"].to_numpy(), pdf["i"].to_numpy(), pdf["j"].to_numpy())
            for lo, hi in zip(cut, cut[1:], strict=False):
                some = pdf.iloc[lo:hi]
                x, rep, copies = units(some["x"]), some["rep"].to_numpy(), some["copies"].to_numpy()
                one = some["t"].to_numpy() == some["i"].iloc[0]
                a = np.flatnonzero(one)
                b = a if one.all() and some["i"].iloc[0] == some["j"].iloc[0] else np.flatnonzero(~one)
                count, u, v = np.zeros(len(x), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
                for i, j in tile_links(x[a], None if b is a else x[b], least):
                    i, j = a[i], b[j]
                    np.add.at(count, i, copies[j])
                    np.add.at(count, j, copies[i])
                    # only a forest of the links found so far is held
                    u, v = forest(np.concatenate([u, rep[i]]), np.concatenate([v, rep[j]]))
                got = np.flatnonzero(count)
                yield pd.DataFrame({"rep": np.concatenate([rep[got], u]), "n": np.concatenate([count[got], np.zeros(len(u), np.int64)]), "to": np.concatenate([rep[got], v])})

    by = ["dim", "i", "j"]
    found = stage(placed.repartition(*by).sortWithinPartitions(*by).mapInPandas(compare, "rep bigint, n bigint, to bigint"), "vec-links")
    n = found.groupBy("rep").agg(F.sum("n").alias("others"))
    comp = stage(connected_components(found.where("rep <> to"), "rep", "to"), "vec-comp")
    known = reps.select("h1", "h2", "rep", "copies").join(n, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("h1", "h2", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"))
    low = ids.groupBy("h1", "h2").agg(F.min("vec_id").alias("low")).join(known, ["h1", "h2"])
    low = stage(low, "vec-low")
    named = low.groupBy("c").agg(F.min("low").alias("name"))
    out = ids.join(low.join(named, "c").select("h1", "h2", "n_links", "name"), ["h1", "h2"], "left")
    alone = F.col("n_links").isNull()
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.when(alone, F.col("vec_id")).otherwise(F.col("name")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
