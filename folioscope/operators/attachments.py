"""Lore books attached to projects: a log of commands folded, in order, into what is attached and what happened.

A project's commands depend on one another only through what is attached at
the time, so they are read as a sorted stream: a task holds the attachments of
one project, never its log. One project is one task's.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

READ_ONLY = "read_only"
FACTS = "project_id string, seq long, lore_id string, kind string, mode string, priority long, updated boolean"


def highest(attached: dict[str, list], tops: list[tuple[int, str]]) -> int:
    """The highest priority attached, -1 without any; ``tops`` is a heap that also holds places given up since."""
    while tops and attached.get(tops[0][1], (None, None))[1] != -tops[0][0]:
        heapq.heappop(tops)
    return -tops[0][0] if tops else -1


def step(attached: dict[str, list], tops: list, verb: str, lore: str, mode: str | None, priority: int | None) -> tuple | None:
    """Apply one command to ``{lore: [mode, priority]}``; the fact it makes, ``(kind, mode, priority, updated)``, or None."""
    row = attached.get(lore)
    if priority is not None and (verb == "attach" or (verb == "priority" and row)):
        heapq.heappush(tops, (-priority, lore))
    if verb == "attach":
        if row is None:
            if priority is None:
                priority = highest(attached, tops) + 1
                heapq.heappush(tops, (-priority, lore))
            row = attached[lore] = [mode or READ_ONLY, priority]
            return "lore.attached", *row, False
        row[:] = [mode or row[0], row[1] if priority is None else priority]
        return "lore.attached", *row, True
    if row is None:
        return None
    if verb == "detach":
        del attached[lore]
        return "lore.detached", None, None, None
    if verb == "mode":
        row[0] = mode
        return "lore.mode_changed", mode, None, None
    row[1] = priority
    return "lore.priority_changed", None, priority, None


def facts(commands: DataFrame) -> DataFrame:
    """Events that the commands ``(project_id, seq, verb, lore_id, mode, priority)`` make, as ``FACTS``.

    Verbs are ``attach`` (again: an update, null keeps what is there), ``detach``,
    ``mode`` and ``priority``. Without a priority a book comes on top of those
    attached. Commands for books that are not attached make nothing; nor do
    commands without a project or a book, or of another verb.
    """
    c = commands.select("project_id", F.col("seq").cast("long").alias("seq"), "verb", "lore_id", "mode", F.col("priority").cast("long").alias("priority"))
    c = c.where(F.col("project_id").isNotNull() & F.col("lore_id").isNotNull() & F.col("verb").isin("attach", "detach", "mode", "priority"))
    c = c.repartition("project_id").sortWithinPartitions("project_id", "seq")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        project, attached, tops = None, {}, []
        for b in batches:
            rows = []
            ranks = b["priority"].astype("Int64")
            for p, seq, verb, lore, mode, rank in zip(b["project_id"], b["seq"], b["verb"], b["lore_id"], b["mode"], ranks, strict=True):
                if p != project:
                    project, attached, tops = p, {}, []
                got = step(attached, tops, verb, lore, mode, None if rank is pd.NA else int(rank))
                if got:
                    rows.append((p, seq, lore, *got))
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in FACTS.split(", ")])
            yield out.astype({"priority": "Int64", "updated": "boolean"})

    return c.mapInPandas(run, FACTS)


def attached_after(made: DataFrame) -> DataFrame:
    """``(project_id, lore_id, mode, priority, attached_at)`` once all facts hold; a book counts from its last attachment.

    The highest priority is first at translation time, see ``glossary.merged_books``.
    """
    born = F.max(F.when(~F.col("updated"), F.col("seq"))).alias("attached_at")
    gone = F.max(F.when(F.col("kind") == "lore.detached", F.col("seq"))).alias("_gone")
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    g = made.groupBy("project_id", "lore_id").agg(last("mode"), last("priority"), born, gone)
    return g.where("_gone is null or attached_at > _gone").drop("_gone")
