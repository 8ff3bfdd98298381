"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], text: str, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that a slice holds about ``most_bytes`` of text (one longer text stays whole)."""
    for b in batches:
        at, n, room = 0, 0, most_bytes
        sizes = pa.compute.fill_null(pa.compute.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False)
        for k, size in enumerate(sizes):
            if n and room < size:
                yield b.slice(at, n)
                at, n, room = k, 0, most_bytes
            n += 1
            room -= size
        if n:
            yield b.slice(at, n)


def raw(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x if x is not None else b"" for x in column.cast(pa.binary()).to_pylist()]


def whole_groups(batches: Iterator[pd.DataFrame], key: list[str], at_least: int) -> Iterator[pd.DataFrame]:
    """Join sorted batches into frames of ``at_least`` rows or more that end where a group ends."""
    held, n = [], 0
    for pdf in batches:
        if not len(pdf):
            continue
        if n >= at_least:
            tail = tuple(held[-1][k].iloc[-1] for k in key)
            same = np.logical_and.reduce([pdf[k].to_numpy() == t for k, t in zip(key, tail, strict=True)])
            cut = len(pdf) if same.all() else int(np.argmin(same))
            held.append(pdf.iloc[:cut])
            if cut == len(pdf):
                n += cut
                continue
            yield pd.concat(held, ignore_index=True)
            held, n, pdf = [], 0, pdf.iloc[cut:]
        held.append(pdf)
        n += len(pdf)
    if held:
        yield pd.concat(held, ignore_index=True)


def runs(*columns: np.ndarray) -> np.ndarray:
    """Start of each run of equal rows, and the end."""
    n = len(columns[0])
    new = np.zeros(n, bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(new), n)


def all_pairs(group: np.ndarray, most: int = 100_000):
    """Yield (i, j), j before i, of all rows of one group, about ``most`` at once; groups are runs of equal values."""
    cut = runs(group)
    first = np.repeat(cut[:-1], np.diff(cut))
    n = np.arange(len(group)) - first
    total = np.append(0, np.cumsum(n))
    at = 0
    while at < len(group):
        to = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        i = np.repeat(np.arange(at, to), n[at:to])
        yield i, first[i] + np.arange(len(i)) - np.repeat(total[at:to] - total[at], n[at:to])
        at = to


def unused(columns: list[str], name: str) -> str:
    """``name``, with underscores in front until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
