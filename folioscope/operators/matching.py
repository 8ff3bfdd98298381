"""Term matching by token anchors, and what is built on it."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from folioscope.functions import text as T

WORDS = r"([\p{L}\p{N}_]+)"


def term_matches(texts: DataFrame, terms: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, entry_id, term, n)``: occurrences of each term in each text, at word boundaries, case-sensitive.

    A match starts at a word boundary, so the term's first word is a whole word
    of the text: texts and terms meet in an equi-join on that word. A term that
    is one word needs no more than the words' count; for the others the
    pattern decides, on the texts that have the word, and each text is read
    once for all its candidates. Terms without any word character have no
    anchor: they are one group that every text carries. Texts are told apart by
    ``key``.
    """
    t = terms.where(F.coalesce(F.col("term"), F.lit("")) != "").select("entry_id", "term", F.regexp_extract("term", WORDS, 1).alias("anchor"))
    one = (F.col("anchor") == F.col("term")).alias("one")
    d = texts.select(F.col(key), F.col(text).alias("_text"))
    words = d.select(key, F.explode(F.regexp_extract_all("_text", F.lit(WORDS))).alias("anchor"))
    anchors = t.where("anchor <> ''").select("anchor").distinct()
    # only words that start a term are counted, so the shuffle is as small as the hits
    hits = words.join(anchors, "anchor", "left_semi").groupBy(key, "anchor").agg(F.count(F.lit(1)).alias("n"))
    cand = hits.join(t.select("anchor", "entry_id", "term", one), "anchor")
    single = cand.where("one").select(key, "entry_id", "term", "n")
    counted = lambda df: (
        df.select(key, "_text", F.explode("_c").alias("x")).select(key, "_text", "x.entry_id", "x.term").withColumn("pattern", T.term_pattern(F.array("term")))
        .withColumn("n", F.expr("regexp_count(_text, pattern)").cast("bigint")).where("n > 0").select(key, "entry_id", "term", "n")
    )
    each = F.collect_list(F.struct("entry_id", "term")).alias("_c")
    many = cand.where("not one").groupBy(key).agg(each)
    bare = t.where("anchor = ''").agg(each).where("size(_c) > 0").withColumn("_at", F.lit(0))  # one row at most
    rest = counted(many.join(d, key)).unionByName(counted(d.withColumn("_at", F.lit(0)).join(F.broadcast(bare), "_at")))
    return single.unionByName(rest)


def occurrence_report(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    return matches.groupBy("entry_id").agg(F.sum("n").cast("bigint").alias("mentions"), F.countDistinct(key).alias("docs"))


SMALL = 50_000  # terms that are sent to every task


def word_character(c: str, known: dict[str, bool] = {}) -> bool:  # noqa: B006  a cache
    if c not in known:
        known[c] = regex.fullmatch(r"[\p{L}\p{N}_]", c) is not None
    return known[c]


def automaton(terms: list[tuple[int, str]]):
    """Aho and Corasick's automaton over ``(entry number, term)``; a term knows its length and all its entries."""
    a = ahocorasick.Automaton()
    owners: dict[str, list[int]] = {}
    for e, t in terms:
        owners.setdefault(t, []).append(e)
    for t, es in owners.items():
        a.add_word(t, (len(t), es))
    if owners:
        a.make_automaton()
    return a


def spans_in(text: str, a) -> list[tuple[int, int, int]]:
    """``(entry number, start, end)`` of all matches: whole words, of one entry leftmost first, then longest, never over one another."""
    hits: dict[int, list[tuple[int, int]]] = {}
    last = len(text) - 1
    for at, (n, owners) in a.iter(text) if len(a) else ():
        start = at + 1 - n
        if (start and word_character(text[start - 1])) or (at < last and word_character(text[at + 1])):
            continue
        for e in owners:
            hits.setdefault(e, []).append((start, -n))
    out = []
    for e, found in hits.items():
        free = 0
        for start, n in sorted(found):
            if start >= free:
                free = start - n
                out.append((e, start, free))
    return out


def glossary_spans(texts: DataFrame, entries: DataFrame, key: str = "doc_id", text: str = "text", small: int = SMALL) -> DataFrame:
    """``(key, entry_id, term, start, end, place)``: every mention of a whole glossary, in order of start, end and entry.

    ``entries`` has ``entry_id`` and the array ``terms`` (the term and its
    aliases). Offsets are code points. Up to ``small`` terms go to every task,
    where one automaton scans each text once. Beyond that texts and terms meet
    on the terms' first words, and each batch of texts builds an automaton of
    the terms that can occur in it; terms without any word character have no
    first word and go to every task as long as they are ``small`` in number.
    Texts are told apart by ``key``.
    """
    spark = texts.sparkSession
    e = entries.select(F.col("entry_id").cast("string").alias("entry_id"), F.explode(F.array_distinct(F.filter("terms", lambda t: t.isNotNull() & (t != "")))).alias("term"))
    e = e.distinct().withColumn("anchor", F.regexp_extract("term", WORDS, 1))
    few = e.limit(small + 1).count() <= small
    fixed = [(r["entry_id"], r["term"]) for r in (e if few else e.where("anchor = ''").limit(small + 1)).select("entry_id", "term").collect()]  # checked: small at most
    if len(fixed) > small:
        raise ValueError(f"more than {small} terms have no word character")
    sent = spark.sparkContext.broadcast(fixed)
    d = texts.select(F.col(key), F.col(text).cast("string").alias("_text"))
    if few:
        d = d.withColumn("_terms", F.array().cast("array<struct<entry_id:string,term:string>>"))
    else:
        own = e.where("anchor <> ''")
        words = d.select(key, F.explode(F.array_distinct(F.regexp_extract_all("_text", F.lit(WORDS)))).alias("anchor"))
        hits = words.join(own, "anchor").groupBy(key).agg(F.collect_list(F.struct("entry_id", "term")).alias("_terms"))
        d = d.join(hits, key, "left")
    kind = dict(texts.dtypes)[key]

    def run(batches):
        always, built = sent.value, None
        for b in batches:
            more = {(t["entry_id"], t["term"]) for ts in b.column("_terms").to_pylist() for t in ts or ()}
            if built is None or more != built[0]:
                ids = sorted({i for i, _ in always} | {i for i, _ in more})
                number = {i: k for k, i in enumerate(ids)}
                built = more, ids, automaton([(number[i], t) for i, t in always] + [(number[i], t) for i, t in more])
            _, ids, a = built
            rows, at = [], []
            for k, t in enumerate(b.column("_text").to_pylist()):
                found = sorted((s, x, e) for e, s, x in spans_in(t, a)) if t else []
                rows += [(ids[e], t[s:x], s, x, place) for place, (s, x, e) in enumerate(found)]
                at += [k] * len(found)
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [key, "entry_id", "term", "start", "end", "place"])

    return d.mapInArrow(run, f"`{key}` {kind}, entry_id string, term string, start int, end int, place int")


def violations(segments: DataFrame, entries: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(key, entry_id, severity)``: entries found in the source of a segment whose target lacks their target term."""
    live = entries.where("status <> 'proposed' and source_term is not null")
    live = live.select(F.col("id").alias("entry_id"), "source_term", "target_term", "target_aliases", F.col("status").alias("rank"), "source_known")
    hits = term_matches(segments, live.select("entry_id", F.col("source_term").alias("term")), key, "source_text")
    both = hits.select(key, "entry_id").distinct().join(live, "entry_id").join(segments.select(key, "target_text"), key)
    used = F.coalesce(F.expr("target_text rlike pattern"), F.lit(False))
    both = both.withColumn("pattern", T.term_pattern(F.concat(F.array("target_term"), F.coalesce("target_aliases", F.array().cast("array<string>")))))
    strict = (F.col("rank") == "locked") & F.col("source_known")
    return both.where(~used).select(key, "entry_id", F.when(strict, "error").otherwise("warning").alias("severity"))


def rename(segments: DataFrame, old: str, new: str, target: str = "target_text") -> DataFrame:
    """Replace a target term at word boundaries; ``replacements`` counts; ``new`` is literal."""
    pattern = T.term_pattern(F.array(F.lit(old)))
    n = F.coalesce(F.regexp_count(F.col(target), pattern), F.lit(0)).cast("bigint")
    put = F.regexp_replace(F.col(target), pattern, F.lit(new.replace("\\", "\\\\").replace("$", "\\$")))
    return segments.withColumn("replacements", n if old != new else F.lit(0).cast("bigint")).withColumn(target, F.when(F.col("replacements") > 0, put).otherwise(F.col(target)))


def affected(segments: DataFrame, source: str, target: str) -> DataFrame:
    """Segments that mention a changed entry, with the side that does; pending ones are left out."""
    s, t = (F.coalesce(F.rlike(F.col(c), T.term_pattern(F.array(F.lit(x)))), F.lit(False)) for c, x in (("source_text", source), ("target_text", target)))
    return segments.where("status <> 'pending'").withColumn("reason", F.when(s & t, "both").when(s, "source").when(t, "target")).where("reason is not null")
