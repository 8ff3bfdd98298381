"""Greedy packing in order, for groups that may hold any share of all rows.

Rows of a group go into a chunk one after another while they fit; one that does
not fit opens the next chunk. Rows are cut into range partitions by group and
order; what a group has in one of them is a block. Inside a block a search in
the prefix sums gives every row its successor, the row that opens the next chunk
if this one opens a chunk, and pointer doubling gives the last such row before
the block's end. So a block is a table: for each filling of the chunk that
comes in, the filling that goes out and how many chunks it opens. It has as
many rows as the budget, whatever the block holds. Tables compose: about sqrt(n)
neighbours at a time become one table, a walk over these and a walk inside each
give every block its filling, and the blocks then place their rows side by side.
No task sees more of a group than one block, or sqrt(n) tables.

Only groups in more than one block need tables, at most two blocks a partition.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from folioscope.plans.staging import stage

FRESH = 0  # no chunk is open; filling c is state c + 1


def successors(total: np.ndarray, end: np.ndarray, budget: int) -> np.ndarray:
    """The row that opens the next chunk if row i opens one: the first that does not fit, ``end[i]`` at most."""
    n = len(total) - 1
    return np.minimum(np.maximum(np.searchsorted(total, total[:-1] + budget, side="right") - 1, np.arange(n) + 1), end)


def fitting(total: np.ndarray, filled, budget: int):
    """How many rows from the first on still fit into a chunk filled that far."""
    return np.maximum(np.searchsorted(total, budget - filled, side="right") - 1, 0)


def block_table(t: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """By state that comes in: state that goes out, and chunks that the block opens."""
    n, total, most = len(t), np.append(0, np.cumsum(t)), budget + 1  # fillings above the budget are all alike
    nxt = successors(total, np.full(n, n), budget)
    last = np.where(nxt < n, nxt, np.arange(n))
    opened = (nxt < n).astype(np.int64)
    while (last[last] != last).any():  # doubling
        opened, last = opened + opened[last], last[last]
    out = np.append(np.minimum(total[n] - total[last], most), 0) + 1
    opened = np.append(opened + 1, 0)
    filled = np.arange(most + 1)
    first = np.append(0, fitting(total, filled, budget))  # the row that opens the first chunk, n: none does
    passed = np.append(0, np.minimum(filled + total[n], most) + 1)
    return np.where(first < n, out[first], passed), opened[first]


def place_block(t: np.ndarray, start: int, state: int, before: int, budget: int, nxt: np.ndarray, total: np.ndarray, end: int) -> tuple[list[int], list[int]]:
    """Rows ``start`` to ``end``: where chunks begin, and their numbers."""
    at, no, heads, numbers = start, before, [], []
    if state != FRESH:
        at = start + int(fitting(total[start : end + 1] - total[start], state - 1, budget))
        if at > start:
            heads, numbers = [start], [before - 1]
    while at < end:
        heads.append(at)
        numbers.append(no)
        at, no = int(nxt[at]), no + 1
    return heads, numbers


def chunked(rows: DataFrame, group: str, idx: str, tokens: Column, budget: int, partitions: int | None = None) -> DataFrame:
    """``(group, idx, tokens, chunk)`` for every row; of equal ``idx`` the smaller comes first. Null tokens count as 0."""
    spark = rows.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kinds = dict(rows.dtypes)
    r = rows.select(F.col(group).alias("g"), F.col(idx).alias("i"), F.coalesce(tokens.cast("bigint"), F.lit(0)).alias("t"))
    r = stage(r.repartitionByRange(n, "g", "i", "t").withColumn("part", F.spark_partition_id()), "greedy-rows")
    mine = lambda a, b: a["g"].eqNullSafe(b["g"])
    blocks = r.groupBy("g", "part").agg(F.count(F.lit(1)).alias("n"))
    several = blocks.groupBy("g").agg(F.count(F.lit(1)).alias("b")).where("b > 1").drop("b")
    blocks = blocks.join(several, mine(blocks, several), "left_semi")
    side = math.isqrt(n) + 1
    blocks = blocks.withColumn("no", F.row_number().over(W.partitionBy("g").orderBy("part")) - 1)  # as many rows as a group has blocks
    blocks = stage(blocks.select("g", "part", "no", F.floor(F.col("no") / side).cast("int").alias("above")), "greedy-blocks")  # two a partition at most

    def table(key: tuple, frame: pa.Table) -> pa.Table:
        frame = frame.take(pc.sort_indices(frame, sort_keys=[("i", "ascending"), ("t", "ascending")], null_placement="at_start"))
        state, opened = block_table(frame["t"].to_numpy(), budget)
        head = frame.slice(0, 1).select(["g", "part", "no", "above"])
        return head.append_column("state", pa.array([state.tobytes()])).append_column("opened", pa.array([opened.tobytes()]))

    b = F.broadcast(blocks.withColumnRenamed("g", "bg").withColumnRenamed("part", "bp"))
    with_blocks = r.join(b, r["g"].eqNullSafe(F.col("bg")) & (r["part"] == F.col("bp"))).drop("bg", "bp")
    g_type = kinds[group]
    tables = stage(with_blocks.groupBy("g", "part").applyInArrow(table, f"g {g_type}, part int, no int, above int, state binary, opened binary"), "greedy-tables")

    def composed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("no")
        state = opened = None
        for s, o in zip(pdf["state"], pdf["opened"], strict=True):
            s, o = np.frombuffer(s, np.int64), np.frombuffer(o, np.int64)
            state, opened = (s, o) if state is None else (s[state], opened + o[state])
        return pdf.iloc[:1][["g", "above"]].assign(state=[state.tobytes()], opened=[opened.tobytes()])

    def walk(by: str, out: list[str]):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(by)
            state, before, states, befores = (int(pdf["s"].iloc[0]), int(pdf["n"].iloc[0]), [], []) if "s" in pdf else (FRESH, 0, [], [])
            for s, o in zip(pdf["state"], pdf["opened"], strict=True):
                states.append(state)
                befores.append(before)
                state, before = int(np.frombuffer(s, np.int64)[state]), before + int(np.frombuffer(o, np.int64)[state])
            return pdf[out].assign(s=states, n=befores)

        return run

    above = tables.groupBy("g", "above").applyInPandas(composed, f"g {g_type}, above int, state binary, opened binary")
    above = above.groupBy("g").applyInPandas(walk("above", ["g", "above"]), f"g {g_type}, above int, s bigint, n bigint")
    u = above.withColumnRenamed("g", "ug").withColumnRenamed("above", "ua")
    inside = tables.join(u, tables["g"].eqNullSafe(u["ug"]) & (tables["above"] == u["ua"])).drop("ug", "ua")
    entry = inside.groupBy("g", "above").applyInPandas(walk("no", ["g", "part"]), f"g {g_type}, part int, s bigint, n bigint")
    e = F.broadcast(entry.withColumnRenamed("g", "eg").withColumnRenamed("part", "ep"))

    def place(frame: pa.Table) -> pa.Table:
        frame = frame.take(pc.sort_indices(frame, sort_keys=[(c, "ascending") for c in ("g", "i", "t")], null_placement="at_start"))
        code = pc.dictionary_encode(frame["g"].combine_chunks(), null_encoding="encode").indices.to_numpy()
        cut = np.append(np.flatnonzero(np.diff(code, prepend=-1)), len(code))
        t = frame["t"].to_numpy()
        total = np.append(0, np.cumsum(t))
        nxt = successors(total, np.repeat(cut[1:], np.diff(cut)), budget)
        states, befores = (pc.fill_null(frame[c], 0).to_numpy() for c in ("s", "n"))
        heads, numbers = [], []
        for x, y in zip(cut.tolist(), cut[1:].tolist(), strict=False):
            h, k = place_block(t, x, int(states[x]), int(befores[x]), budget, nxt, total, y)
            heads += h
            numbers += k
        chunk = np.repeat(np.array(numbers, np.int64), np.diff(np.append(heads, len(t)).astype(np.int64)))
        return frame.select(["g", "i", "t"]).append_column("chunk", pa.array(chunk))

    out = r.join(e, r["g"].eqNullSafe(F.col("eg")) & (r["part"] == F.col("ep")), "left").select("part", "g", "i", "t", "s", "n")
    out = out.groupBy("part").applyInArrow(place, f"g {g_type}, i {kinds[idx]}, t bigint, chunk bigint")
    return out.select(F.col("g").alias(group), F.col("i").alias(idx), F.col("t").alias("tokens"), "chunk")
