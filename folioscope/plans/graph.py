"""Connected components over edge tables, without gathering edges anywhere.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", SoCC 2014). Every step is a map-side
combined minimum and a join on its key, so a hub's edges can be split by
adaptive skew handling; rounds grow with the logarithm of the diameter.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioscope.plans.staging import stage, unstage


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) with root the smallest node of each local component; roots themselves are left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    lab = np.arange(len(nodes))
    while len(x):
        lx, ly = lab[x], lab[y]
        hi, lo = np.maximum(lx, ly), np.minimum(lx, ly)
        np.minimum.at(lab, hi, lo)
        while True:
            nxt = lab[lab]
            if np.array_equal(nxt, lab):
                break
            lab = nxt
        keep = lab[x] != lab[y]
        x, y = x[keep], y[keep]
    moved = lab != np.arange(len(nodes))
    return nodes[moved], nodes[lab[moved]]


def _contract(batches):
    """Replace each bounded slice of edges by a spanning star forest of it."""
    held: list[pd.DataFrame] = []
    n = 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= 2_000_000:
            p = pd.concat(held)
            u, v = forest(p["u"].to_numpy(), p["v"].to_numpy())
            held, n = [pd.DataFrame({"u": u, "v": v})], len(u)
            if n >= 1_000_000:
                yield held.pop()
                n = 0
    if n:
        p = pd.concat(held)
        u, v = forest(p["u"].to_numpy(), p["v"].to_numpy())
        yield pd.DataFrame({"u": u, "v": v})


def _mark(df: DataFrame) -> tuple[int, int]:
    r = df.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("bigint"))).first()
    return r[0], r[1] or 0


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 40) -> DataFrame:
    """``(node, component)`` for every node that an edge touches; component is the smallest node reachable.

    ``src`` and ``dst`` are bigint columns; null ends and self loops are ignored.
    """
    e = edges.select(F.col(src).cast("bigint").alias("x"), F.col(dst).cast("bigint").alias("y"))
    e = e.where("x is not null and y is not null and x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    cur = stage(e.mapInPandas(_contract, "u bigint, v bigint").distinct(), "cc")
    seen = _mark(cur)
    for _ in range(max_rounds if seen[0] else 0):
        # large star: every larger neighbour of u hangs below the smallest of u and its neighbours
        sym = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: u and its smaller neighbours hang below the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        below = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = stage(below.union(low.select("u", F.col("m").alias("v"))).distinct(), "cc")
        now = _mark(nxt)
        # equal marks may be chance: only equal edges end the rounds
        settled = now == seen and nxt.join(cur, ["u", "v"], "left_anti").isEmpty()
        unstage(cur)
        cur = nxt
        if settled:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = cur.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
