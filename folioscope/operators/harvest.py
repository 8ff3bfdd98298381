"""Prose of whole books in chunks of bounded length, cut where a reader would pause.

Chapters are joined by a blank line while they fit. What is longer is cut at
the last paragraph break, else sentence end, that lies in the second half of
the allowed length, else at the last blank, else at the length itself. Where a
chunk ends depends on all that came before it in the book, so a book streams
through one task in order; what the task holds is one chapter and one chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from folioscope.functions import text as T

#: Marks to cut at, how many of their characters stay in front of the cut, and the least place as a part of the length.
BREAKS = [(("\n\n",), 0, 0.5), ((". ", "! ", "? "), 2, 0.5), ((" ",), 0, 0.0)]


def cut_point(text: str, most: int) -> int:
    """Where a text longer than ``most`` is cut."""
    for marks, keep, least in BREAKS:
        at = max(text.rfind(m, 0, most + len(m)) for m in marks)
        if at > most * least:
            return at + keep
    return most


def pieces(held: str, most: int) -> tuple[list[str], str]:
    """Whole chunks of what is held, and the rest that fits into one."""
    out = []
    while len(held) > most:
        at = cut_point(held, most)
        out.append(held[:at].strip())
        held = held[at:].strip()
    return out, held


def prose_chunks(chapters: DataFrame, book: str, order: str, text: str, most: int) -> DataFrame:
    """``(book, chunk, text)``: the books' prose without placeholders, white space squeezed; blank chapters count for nothing.

    Lengths are code points. Of chapters with equal ``order`` the smaller text comes first.
    """
    kind = dict(chapters.dtypes)[book]
    prose = T.squeeze(F.regexp_replace(F.col(text), T.TOKEN, ""))
    rows = chapters.select(F.col(book).alias("book"), F.col(order).alias("o"), prose.alias("t"), F.coalesce(F.col(book).cast("string"), F.lit("\u0000")).alias("name")).where("t <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, book_, held, n = None, None, "", 0
        for pdf in batches:
            out = []
            for name, b, t in zip(pdf["name"], pdf["book"], pdf["t"], strict=True):
                if name != now:
                    if held:
                        out.append((book_, n, held))
                    now, book_, held, n = name, b, "", 0
                full = []
                if held and len(held) + len(t) + 2 <= most:
                    held += "\n\n" + t
                else:
                    full, held = [held] if held else [], t
                more, held = pieces(held, most)
                for chunk in full + more:
                    out.append((book_, n, chunk))
                    n += 1
            yield pd.DataFrame(out, columns=["book", "chunk", "text"])
        if held:
            yield pd.DataFrame([(book_, n, held)], columns=["book", "chunk", "text"])

    dealt = rows.repartition("name").sortWithinPartitions("name", "o", "t").select("name", "book", "t")
    return dealt.mapInPandas(run, f"book {kind}, chunk bigint, text string").withColumnRenamed("book", book)
