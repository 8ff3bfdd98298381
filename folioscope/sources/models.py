"""Model sources behind one interface: batches of texts in, vectors or replies out. Offline stand-ins are the default."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

DIM = 32


def mock_vector(text: str, dim: int = DIM) -> np.ndarray:
    """A unit vector from the text's hash: xorshift numbers in [-1, 1) as float32."""
    x = int(hashlib.sha256(text.encode()).hexdigest()[:8], 16) or 1
    out = []
    for _ in range(dim):
        x ^= x << 13 & 0xFFFFFFFF
        x ^= x >> 17
        x ^= x << 5 & 0xFFFFFFFF
        out.append(x / 2**31 - 1)
    v = np.array(out, np.float32)
    n = np.sqrt((v.astype(np.float64) ** 2).sum())
    return (v / n).astype(np.float32) if n else v


def mock_embed(texts: list[str]) -> list[np.ndarray]:
    return [mock_vector(t) for t in texts]


def embed(df: DataFrame, id_col: str, text_col: str, embedder: Callable[[list[str]], list] = mock_embed, batch: int = 64) -> DataFrame:
    """``(id, vector)`` in request batches; every reply must have one length."""
    kind = dict(df.dtypes)[id_col]

    def run(batches):
        for pdf in batches:
            for at in range(0, len(pdf), batch):
                some = pdf.iloc[at : at + batch]
                got = embedder(some[text_col].fillna("").tolist())
                if len(got) != len(some) or len({len(v) for v in got}) > 1:
                    raise ValueError("the embedding source returned vectors of other number or lengths")
                yield pd.DataFrame({id_col: some[id_col].to_numpy(), "vector": [np.asarray(v, np.float32) for v in got]})

    return df.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, vector array<float>")
