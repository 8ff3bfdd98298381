"""Queries over the sample tables, one or more for each operator family, with the same query in DuckDB SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from folioscope.functions import text as T
from folioscope.operators import attachments, batch, context, dedup, glossary, harvest, imports, ledger, matching, merging, prompts, proposals, reading, replays, retrieval, summaries, tables
from folioscope.plans.staging import shared_dir
from folioscope.sources import exchange, lorebook
from folioscope.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def tab(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def values(spark: SparkSession, sql: str) -> DataFrame:
    return spark.sql(f"SELECT * FROM {sql}")


TERMS = "(VALUES ('e1','the'),('e2','of'),('e3','and'),('e4','de'),('e5','la'),('e6','der'),('e7','die'),('e8','with')) AS t(entry_id, term)"
GLOSSARY = """(VALUES ('g1','p1','the','der','term','locked',true,'n1',CAST(NULL AS STRING),3),('g2','p1','of','von','term','confirmed',true,NULL,'m',1),
 ('g3','p1','and','und','place','proposed',true,NULL,NULL,2),('g4','p1',NULL,'Haus','term','locked',false,NULL,NULL,5),('g5','p2','with','mit','person','confirmed',true,'say "x"','f',4),
 ('g6','p2','the','das','term','proposed',true,NULL,NULL,6),('g7','p2','from','aus','term','locked',true,NULL,NULL,7),('g8','p2',NULL,'Garten','term','confirmed',false,NULL,NULL,8),
 ('g9','p2','The','Der','term','confirmed',true,NULL,NULL,9)) AS g(id, project_id, source_term, target_term, type, status, source_known, notes, gender, created_at)"""
PRICES = "(VALUES ('gpt',1.0D,2.0D),('gpt-large',3.0D,6.0D),('ada',0.1D,0.1D)) AS p(name, prompt_price, completion_price)"


def duck(sql: str) -> str:
    return sql.replace("STRING)", "VARCHAR)").replace("0D", "0::DOUBLE").replace("1D", "1::DOUBLE")


def chapters(docs: DataFrame) -> DataFrame:
    """Documents as segments: a chapter for each source, in id order."""
    return docs.select("doc_id", "text", "lang", F.col("source").alias("chapter"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).cast("bigint").alias("idx"))


SEGMENTS = """(SELECT d.doc_id, d.source AS chapter, d.text AS source_text, replace(d.text, 'the', 'der') AS target_text,
 CASE WHEN l.toxic = 1 THEN 'flagged' WHEN l.quality = 1 THEN 'approved' WHEN l.doc_id IS NOT NULL THEN 'translated' ELSE 'pending' END AS status
 FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    lab = tab(spark, d, "labels")
    status = F.when(F.col("toxic") == 1, "flagged").when(F.col("quality") == 1, "approved").when(F.col("quality").isNotNull(), "translated").otherwise("pending")
    docs = tab(spark, d, "documents").join(lab, "doc_id", "left")
    return docs.select("doc_id", F.col("source").alias("chapter"), F.col("text").alias("source_text"), F.replace("text", F.lit("the"), F.lit("der")).alias("target_text"), status.alias("status"))


# term matching


def _hits(term: str, text: str) -> str:
    return f"len(list_filter(regexp_extract_all({text}, '[\\p{{L}}\\p{{N}}_]+'), lambda x: x = {term}))"


@query(f"""SELECT entry_id, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS docs FROM (
 SELECT t.entry_id, d.doc_id, {_hits('t.term', 'd.text')} AS n FROM documents d, {TERMS}) WHERE n > 0 GROUP BY entry_id""")
def term_occurrences(spark, d):
    return matching.occurrence_report(matching.term_matches(tab(spark, d, "documents"), values(spark, TERMS)))


@query(f"""SELECT d.lang, t.term, count(*) AS docs FROM documents d, {TERMS} WHERE {_hits('t.term', 'd.text')} > 0 GROUP BY d.lang, t.term""")
def term_existence_by_lang(spark, d):
    docs = tab(spark, d, "documents")
    return matching.term_matches(docs, values(spark, TERMS)).join(docs.select("doc_id", "lang"), "doc_id").groupBy("lang", "term").agg(F.countDistinct("doc_id").alias("docs"))


@query(f"""SELECT s.doc_id, g.id AS entry_id, CASE WHEN g.status = 'locked' AND g.source_known THEN 'error' ELSE 'warning' END AS severity
 FROM {SEGMENTS} s, {duck(GLOSSARY)} WHERE g.status <> 'proposed' AND g.source_term IS NOT NULL
 AND {_hits('g.source_term', 's.source_text')} > 0 AND {_hits('g.target_term', 's.target_text')} = 0""")
def violations(spark, d):
    g = values(spark, GLOSSARY).withColumn("target_aliases", F.array().cast("array<string>"))
    return matching.violations(segments(spark, d), g)


@query(f"""SELECT doc_id, CASE WHEN a > 0 AND b > 0 THEN 'both' WHEN a > 0 THEN 'source' ELSE 'target' END AS reason FROM (
 SELECT doc_id, {_hits("'of'", 'source_text')} AS a, {_hits("'der'", 'target_text')} AS b FROM {SEGMENTS} WHERE status <> 'pending') WHERE a > 0 OR b > 0""")
def cascade_affected(spark, d):
    return matching.affected(segments(spark, d), "of", "der").select("doc_id", "reason")


@query(f"""SELECT doc_id, CAST({_hits("'der'", 'target_text')} AS BIGINT) AS replacements FROM {SEGMENTS}""")
def rename_counts(spark, d):
    return matching.rename(segments(spark, d), "der", "$1 DAS").select("doc_id", "replacements")


ENTRIES = "(VALUES ('e1', array('the')), ('e2', array('of', 'of the')), ('e3', array('la', 'de', 'de la')), ('e4', array('und', 'und der', 'et')), ('e5', array('the'))) AS t(entry_id, terms)"


@query("""WITH w AS (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS ws, regexp_split_to_array(text, '[\\p{L}\\p{N}_]+') AS gaps FROM documents),
 p AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i, unnest(gaps[1:len(ws)]) AS before, unnest(list_concat(ws[2:], ['' ])) AS nxt, unnest(gaps[2:len(ws) + 1]) AS gap FROM w),
 o AS (SELECT *, CAST(sum(length(before) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) AS INTEGER) - length(word) AS pos FROM p),
 t AS (SELECT * FROM (VALUES ('e1','the',NULL),('e2','of',NULL),('e2','of','the'),('e3','la',NULL),('e3','de',NULL),('e3','de','la'),('e4','und',NULL),('e4','und','der'),('e4','et',NULL),('e5','the',NULL)) AS t(entry_id, w1, w2)),
 h AS (SELECT doc_id, i, entry_id, CASE WHEN w2 IS NULL THEN word ELSE word || ' ' || w2 END AS term, pos AS start, pos + length(word) + coalesce(length(w2) + 1, 0) AS "end", w2 IS NOT NULL AS two
  FROM o JOIN t ON word = w1 AND (w2 IS NULL OR (nxt = w2 AND gap = ' ')) QUALIFY row_number() OVER (PARTITION BY doc_id, i, entry_id ORDER BY w2 IS NULL) = 1),
 k AS (SELECT * FROM h WINDOW x AS (PARTITION BY doc_id, entry_id ORDER BY i) QUALIFY NOT coalesce(lag(two) OVER x AND lag(i) OVER x = i - 1, false))
 SELECT doc_id, entry_id, term, CAST(start AS INTEGER) AS start, CAST("end" AS INTEGER) AS "end", CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start, "end", entry_id) - 1 AS INTEGER) AS place FROM k""")
def glossary_spans(spark, d):
    return matching.glossary_spans(tab(spark, d, "documents"), values(spark, ENTRIES))


# ledger and event reports


@query("""SELECT count(*) AS total, count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'flagged') AS flagged,
 count(*) FILTER (status = 'approved') AS approved, count(*) FILTER (status = 'translated') AS translated FROM """ + SEGMENTS)
def doc_status_pivot(spark, d):
    n = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return segments(spark, d).agg(F.count(F.lit(1)).alias("total"), *map(n, ("pending", "flagged", "approved", "translated")))


@query(f"SELECT chapter, status, count(*) AS n FROM {SEGMENTS} GROUP BY ALL")
def status_facets(spark, d):
    return segments(spark, d).groupBy("chapter", "status").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT event_type FROM events")
def event_kind_distinct(spark, d):
    return tab(spark, d, "events").select("event_type").distinct()


@query("""SELECT event_type, count(*) AS n, max(CAST(json_extract(props, '$.k') AS BIGINT)) AS max_k FROM
 (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY event_type""")
def event_digest_last200(spark, d):
    last = tab(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200)
    kept = last.where(F.col("event_type").isin("error", "purchase", "signup"))
    return kept.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max(F.from_json("props", "k bigint")["k"]).alias("max_k"))


@query("""SELECT event_type, count(*) AS n, round(avg(value) FILTER (value >= 0), 6) AS avg_value, max(value) FILTER (value >= 0) AS max_value FROM
 (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 500) GROUP BY event_type""")
def activity_recent_n(spark, d):
    last = tab(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(500)
    ok = F.when(F.col("value") >= 0, F.col("value"))
    return last.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 6).alias("avg_value"), F.max(ok).alias("max_value"))


@query("SELECT event_type, round(sum(coalesce(value, 0)), 4) AS cost, count(*) AS calls FROM events GROUP BY event_type")
def cost_by_kind(spark, d):
    return tab(spark, d, "events").groupBy("event_type").agg(F.round(F.sum(F.coalesce("value", F.lit(0.0))), 4).alias("cost"), F.count(F.lit(1)).alias("calls"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def latest_event_per_user(spark, d):
    return tables.latest(tab(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query(f"""SELECT s.doc_id, s.chapter, e.event_id, e.event_type FROM (SELECT * FROM {SEGMENTS} WHERE status = 'flagged') s LEFT JOIN
 (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1) e ON s.doc_id = e.user_id""")
def flagged_with_latest_event(spark, d):
    e = tables.latest(tab(spark, d, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")])
    s = segments(spark, d).where("status = 'flagged'")
    return s.join(e, s["doc_id"] == e["user_id"], "left").select("doc_id", "chapter", "event_id", "event_type")


@query("""SELECT c.c_custkey, o.o_orderkey, l.l_linenumber, row_number() OVER (PARTITION BY c.c_custkey ORDER BY o.o_orderdate, o.o_orderkey, l.l_linenumber) AS place
 FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey""")
def occurrence_join3(spark, d):
    j = tab(spark, d, "lineitem").join(tab(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(tab(spark, d, "customer").select("c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    return j.select("c_custkey", "o_orderkey", "l_linenumber", F.row_number().over(W.partitionBy("c_custkey").orderBy("o_orderdate", "o_orderkey", "l_linenumber")).cast("bigint").alias("place"))


@query(f"""SELECT c.chapter, CAST(coalesce(p.n, 0) AS BIGINT) AS pending FROM (SELECT DISTINCT source AS chapter FROM documents) c LEFT JOIN
 (SELECT chapter, count(*) AS n FROM {SEGMENTS} WHERE status = 'flagged' GROUP BY chapter) p USING (chapter)""")
def pending_per_chapter_zero_fill(spark, d):
    s = segments(spark, d)
    p = s.where("status = 'flagged'").groupBy("chapter").agg(F.count(F.lit(1)).alias("n"))
    return s.select("chapter").distinct().join(p, "chapter", "left").select("chapter", F.coalesce("n", F.lit(0)).cast("bigint").alias("pending"))


@query("""SELECT user_id, count(*) AS n, round(100.0 * count(*) FILTER (event_type = 'click') / count(*), 4) AS hit_rate FROM events GROUP BY user_id""")
def cache_rate(spark, d):
    g = tab(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("event_type") == "click", 1)).alias("h"))
    return g.select("user_id", "n", ledger.rate(F.col("h"), F.col("n")).alias("hit_rate"))


@query("""SELECT event_id, event_type FROM events WHERE contains(lower(event_type || chr(10) || props), 'k": 7') OR contains(lower(event_type), 'pur')""")
def free_text_filter(spark, d):
    hay = F.lower(F.concat_ws("\n", "event_type", "props"))
    return tab(spark, d, "events").where(hay.contains('k": 7') | F.lower("event_type").contains("pur")).select("event_id", "event_type")


@query("""SELECT o_custkey, o_orderkey AS last_run, o_orderdate AS started FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_run_per_owner(spark, d):
    g = tab(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderdate"), F.struct("o_orderdate", "o_orderkey")).alias("x"))
    return g.select("o_custkey", F.col("x.o_orderkey").alias("last_run"), F.col("x.o_orderdate").alias("started"))


@query("""SELECT event_type, CASE WHEN value > 50 THEN 'flagged' WHEN user_id % 3 = 0 THEN 'cached' ELSE 'translated' END AS outcome, count(*) AS n,
 CAST(sum(event_id) AS BIGINT) AS tokens, round(sum(value), 3) AS cost FROM events GROUP BY ALL""")
def batch_outcomes(spark, d):
    e = tab(spark, d, "events").select("event_type", (F.col("value") > 50).cast("int").alias("n_violations"), (F.col("user_id") % 3 == 0).cast("int").alias("cache_hit"), F.col("event_id").alias("tokens"), F.col("value").alias("cost"))
    return ledger.outcomes(e, "event_type").withColumn("cost", F.round("cost", 3))


# vectors

COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@query(f"""SELECT q.vec_id AS query_id, r.vec_id AS ref_id, round({COS.format(a='q.embedding', b='r.embedding')}, 6) AS sim,
 row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS.format(a='q.embedding', b='r.embedding')} DESC, r.vec_id) AS place
 FROM embeddings q JOIN embeddings r ON q.vec_id <> r.vec_id WHERE q.vec_id % 20 = 0 AND {COS.format(a='q.embedding', b='r.embedding')} >= 0.2 QUALIFY place <= 5""")
def cosine_topk(spark, d):
    v = tab(spark, d, "embeddings")
    return dedup.top_k(v.where("vec_id % 20 = 0"), v, "vec_id", "embedding", 5, 0.2).withColumn("sim", F.round("sim", 6))


@query(f"""SELECT a.vec_id AS a, b.vec_id AS b, round({COS.format(a='a.embedding', b='b.embedding')}, 6) AS sim FROM embeddings a JOIN embeddings b
 ON a.label = b.label AND a.vec_id < b.vec_id WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.3""")
def cosine_pairs_same_label(spark, d):
    return dedup.cosine_pairs(tab(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3).withColumn("sim", F.round("sim", 6))


@query(f"""WITH RECURSIVE l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
 WHERE {COS.format(a='a.embedding', b='b.embedding')} >= 0.3), w AS (SELECT a, a AS b FROM l UNION SELECT w.a, l.b FROM w JOIN l ON w.b = l.a),
 c AS (SELECT a, min(b) AS component FROM w GROUP BY a) SELECT component, count(*) AS n, list_sort(list(a)) AS members FROM c GROUP BY component""")
def embedding_clusters(spark, d):
    return dedup.clusters(dedup.cosine_pairs(tab(spark, d, "embeddings"), "vec_id", "embedding", "label", 0.3))


@query("SELECT label, count(*) AS vectors, count(DISTINCT vec_id) AS refs FROM embeddings GROUP BY label")
def model_histogram(spark, d):
    return tab(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"), F.countDistinct("vec_id").alias("refs"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)")
def anti_embedded(spark, d):
    return tables.delete(tab(spark, d, "documents").select("doc_id"), tab(spark, d, "embeddings"), "doc_id", "vec_id")


@query(f"""WITH s AS (SELECT e.vec_id AS id, e.vec_id % 5 AS spine, e.vec_id // 5 AS idx, e.embedding AS v, e.vec_id % 4 <> 0 AND trim(d.text) <> '' AS ok, 2 * length(d.text) AS size FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
 j AS (SELECT a.id AS q, b.id AS r, b.size, row_number() OVER (PARTITION BY a.id ORDER BY round({COS.format(a='a.v', b='b.v')}, 12) DESC, b.id) AS place FROM s a JOIN s b
  ON (b.spine < a.spine OR (b.spine = a.spine AND b.idx < a.idx)) AND b.ok WHERE round({COS.format(a='a.v', b='b.v')}, 12) >= 0.1 QUALIFY place <= 5),
 k AS (SELECT *, sum(size) OVER (PARTITION BY q ORDER BY place) AS spent FROM j)
 SELECT q AS id, list(r ORDER BY place) AS refs FROM k WHERE place = 1 OR spent <= 6000 GROUP BY q""")
def relevant_context(spark, d):
    e, docs = tab(spark, d, "embeddings"), tab(spark, d, "documents")
    id_ = F.col("doc_id").alias("id")
    s = docs.join(e.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi")
    s = s.select(id_, (F.col("doc_id") % 5).alias("spine"), F.expr("doc_id div 5").alias("idx"), F.when(F.col("doc_id") % 4 == 0, "pending").otherwise("translated").alias("status"), F.replace("text", F.lit("the"), F.lit("der")).alias("target_text"), F.col("text").alias("source_text"))
    return retrieval.relevant(s, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), k=5, least=0.1, budget=6000)


BOOKS = "(VALUES (0,3,0.1D),(1,NULL,NULL),(2,0,NULL),(3,5,0.2D),(4,-1,0.9D),(5,2,NULL)) AS b(lore_id, top_k, min_similarity)"


@query(f"""WITH j AS (SELECT q.vec_id AS query_id, b.lore_id, e.vec_id AS id, coalesce(b.top_k, 4) AS k, coalesce(b.min_similarity, 0.15) AS least, round({COS.format(a='q.embedding', b='e.embedding')}, 12) AS sim
 FROM embeddings q, embeddings e JOIN {BOOKS.replace('D)', '::DOUBLE)')} ON e.vec_id % 7 = b.lore_id WHERE q.vec_id % 20 = 0 AND e.vec_id % 11 <> 0)
 SELECT query_id, lore_id, id FROM j WHERE k <= 0 OR sim >= least QUALIFY k <= 0 OR row_number() OVER (PARTITION BY query_id, lore_id ORDER BY sim DESC, id) <= k""")
def lore_retrieval(spark, d):
    e = tab(spark, d, "embeddings")
    entries = e.select((F.col("vec_id") % 7).cast("int").alias("lore_id"), F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.when(F.col("vec_id") % 11 == 0, "proposed").otherwise("confirmed").alias("status"))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return retrieval.from_books(q, entries, values(spark, BOOKS), k=4, least=0.15)


# duplicates


@query("""WITH t AS (SELECT s_name AS k FROM supplier) SELECT a.k AS a, b.k AS b FROM t a JOIN t b ON a.k < b.k
 AND left(a.k, least(3, length(a.k), length(b.k))) = left(b.k, least(3, length(a.k), length(b.k))) AND levenshtein(a.k, b.k) <= 2""")
def near_dup_pairs(spark, d):
    t = tab(spark, d, "supplier").select(F.col("s_name").alias("k"))
    return dedup.near_pairs(t, "k", "k")


SPELT = """(SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN left(p_name, length(p_name) - 1) WHEN 2 THEN left(p_name, 4) || chr(CAST(97 + p_partkey % 23 AS INTEGER)) || substr(p_name, 5)
 ELSE left(p_name, 3) || chr(CAST(97 + p_partkey % 19 AS INTEGER)) || substr(p_name, 6) || chr(CAST(97 + p_partkey % 7 AS INTEGER)) END AS k FROM part)"""


@query(f"""SELECT a.id AS a, b.id AS b FROM {SPELT} a JOIN {SPELT} b ON a.id < b.id AND left(a.k, least(3, length(a.k), length(b.k))) = left(b.k, least(3, length(a.k), length(b.k)))
 AND abs(length(a.k) - length(b.k)) <= 2 AND levenshtein(a.k, b.k) <= 2""")
def near_spellings(spark, d):
    n, k = F.col("p_name"), F.col("p_partkey")
    letter = lambda m: F.char((97 + k % m).cast("int"))
    made = F.when(k % 4 == 0, n).when(k % 4 == 1, F.left(n, F.length(n) - 1)).when(k % 4 == 2, F.concat(F.left(n, F.lit(4)), letter(23), F.substr(n, F.lit(5))))
    made = made.otherwise(F.concat(F.left(n, F.lit(3)), letter(19), F.substr(n, F.lit(6)), letter(7)))
    return dedup.near_pairs(tab(spark, d, "part").select(k.alias("id"), made.alias("k")), "id", "k")


@query("""SELECT p_name AS source_term, count(*) AS n, list(p_partkey ORDER BY p_retailprice, p_partkey) AS ids FROM part GROUP BY p_name HAVING count(*) > 1""")
def exact_dup_groups(spark, d):
    p = tab(spark, d, "part").select(F.col("p_name").alias("source_term"), F.lit("locked").alias("status"), F.lit("x").alias("type"), F.col("p_retailprice").alias("created_at"), F.col("p_partkey").alias("id"))
    return glossary.duplicates(p)


@query("SELECT sha256(text) AS h, count(*) AS n, min(doc_id) AS winner FROM documents GROUP BY text HAVING count(*) > 1")
def dup_documents(spark, d):
    return tab(spark, d, "documents").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("winner")).where("n > 1")


# text


# the oracles spell the particles out themselves
SQL_PARTICLES = """(VALUES ('en',['the','a','an']),('es',['el','la','los','las','un','una','unos','unas','de','en','por','para','con','del','al']),
 ('fr',['le','la','les','un','une','des','de','en','à','du','au','aux']),('de',['der','die','das','den','dem','des','ein','eine','einen','einem','einer','eines',
 'in','an','auf','zu','von','mit','bei','im','am','zum','zur','vom','beim'])) AS p(lang, words)"""


@query(f"""WITH w AS (SELECT doc_id, p.words, regexp_extract_all(text, '\\p{{L}}+(?:''\\p{{L}}+)?') AS ws, regexp_split_to_array(text, '\\p{{L}}+(?:''\\p{{L}}+)?') AS gaps
 FROM documents d JOIN {SQL_PARTICLES} ON p.lang = CASE WHEN d.lang IN ('es', 'fr', 'de') THEN d.lang ELSE 'en' END),
 p AS (SELECT *, unnest(range(1, len(ws))) AS i FROM w)
 SELECT doc_id, lower(ws[i]) AS word, CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ws[1:i-1], lambda x: length(x))), 0) AS INTEGER) AS at
 FROM p WHERE lower(ws[i]) = lower(ws[i + 1]) AND list_contains(words, lower(ws[i]))""")
def doubled_particles(spark, d):
    docs = tab(spark, d, "documents")
    return docs.select("doc_id", F.explode(T.doubled_particles(F.col("text"), F.col("lang"))).alias("x")).select("doc_id", "x.word", "x.at")


@query(f"""SELECT doc_id, CASE WHEN regexp_matches(trim(text), '^\\S+\\s') AND list_contains(p.words, lower(trim(regexp_extract(trim(text), '^(\\S+)', 1), '.,;:!?"`«»()[]{{}}''')))
 THEN lower(trim(regexp_extract(trim(text), '^(\\S+)', 1), '.,;:!?"`«»()[]{{}}''')) END AS particle
 FROM documents d JOIN {SQL_PARTICLES} ON p.lang = CASE WHEN d.lang IN ('es', 'fr', 'de') THEN d.lang ELSE 'en' END""")
def leading_particle(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.leading_particle(F.col("text"), F.col("lang")).alias("particle"))


@query("""SELECT doc_id, regexp_matches(trim(text), '^[—–―]\\s*\\S') OR regexp_matches(text, '[“„«「『＂‘‚‹”»」』’›]') OR regexp_matches(text, '"[^"]*[\\p{L}\\p{N}][^"]*"') AS is_dialogue FROM documents""")
def dialogue_flag(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.dialogue(F.col("text")).alias("is_dialogue"))


@query("SELECT doc_id, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tokens, CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4)) END AS BIGINT) AS llm_tokens FROM documents")
def token_counts(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.rough_tokens(F.col("text")).alias("tokens"), T.rough_tokens(F.col("text"), 0).alias("llm_tokens"))


YEARS = """(SELECT o_orderkey, CASE o_orderkey % 16 WHEN 0 THEN y WHEN 1 THEN 'c. ' || y WHEN 2 THEN '(' || y || ')' WHEN 3 THEN y || ' - ' || (o_custkey % 10000) WHEN 4 THEN y || ' BC.' WHEN 5 THEN y || 's' WHEN 6 THEN 'Order ' || y
 WHEN 7 THEN y || ' d.C.' WHEN 8 THEN 'circa ' || y || 'AD' WHEN 9 THEN 'ca ' || y || ' n. Chr' WHEN 10 THEN y || ' ' || y WHEN 11 THEN o_orderpriority WHEN 12 THEN y || '-' || y || 's' WHEN 13 THEN 'AD ' || y || '!?' WHEN 14 THEN y || o_custkey ELSE y || ' to ' || y END AS term
 FROM (SELECT *, CAST(o_orderkey % 2300 AS VARCHAR) AS y FROM orders))"""


def year_terms(spark, d):
    y, k = (F.col("o_orderkey") % 2300).cast("string"), F.col("o_orderkey") % 16
    forms = ["{y}", "c. {y}", "({y})", "{y} - {c}", "{y} BC.", "{y}s", "Order {y}", "{y} d.C.", "circa {y}AD", "ca {y} n. Chr", "{y} {y}", "{p}", "{y}-{y}s", "AD {y}!?", "{y}{k}", "{y} to {y}"]
    parts = {"{y}": y, "{c}": (F.col("o_custkey") % 10000).cast("string"), "{p}": F.col("o_orderpriority"), "{k}": F.col("o_custkey").cast("string")}
    made = [F.concat(*(parts.get(x, F.lit(x)) for x in re.split(r"(\{.\})", f) if x)) for f in forms]
    term = F.element_at(F.array(*made), (k + 1).cast("int"))
    return tab(spark, d, "orders").select("o_orderkey", term.alias("term"))


_ERA, _CIRCA = (r"(?i)\b(AD|BC|BCE|CE|a\.?\s*C\.?|d\.?\s*C\.?|n\.?\s*Chr\.?|v\.?\s*Chr\.?)\b", r"(?i)^\s*(c\.?|ca\.?|circa|cca\.?|approx\.?|aprox\.?)\s+")


@query(rf"""SELECT o_orderkey, regexp_matches(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(regexp_replace(term, '^[(]+|[)]+$', '', 'g')), '{_ERA}', '', 'g')), '{_CIRCA}', '')), '[.,;:!?]+$', '')), '(?i)^\d{{1,4}}(\s*[-–—]\s*\d{{1,4}})?s?$') AS plain,
 regexp_matches(term, '(?i)^\s*(c\.?\s*)?\d{{1,4}}(s|\s*(BC|AD|CE|BCE))?\s*$') OR regexp_matches(term, '^\s*\d{{1,4}}\s*[-–]\s*\d{{1,4}}\s*$') AS proposed,
 regexp_matches(term, '(?i)^(c\.\s*)?\d{{1,4}}(\s*(–|—|-|to)\s*\d{{1,4}})?(\s*(BC|AD|BCE|CE|s))?$') AS in_target FROM {{YEARS}}""".replace("\\\\", "\\").replace("{YEARS}", YEARS))
def year_variants(spark, d):
    t = F.col("term")
    return year_terms(spark, d).select("o_orderkey", T.year_like(t).alias("plain"), T.year_proposed(t).alias("proposed"), T.year_in_target(t).alias("in_target"))


@query(r"""SELECT conv_id, turn, CASE WHEN c = '' THEN 'empty' WHEN length(c) > 100 THEN 'too_long' WHEN n > 10 THEN 'too_many_words' WHEN regexp_matches(c, '[.!?]\s+\S') OR regexp_matches(c, '[!?](\s|$)') THEN 'sentence' END AS source_fault,
 CASE WHEN c = '' THEN 'empty' WHEN length(c) > 100 THEN 'too_long' WHEN n > 10 THEN 'too_many_words' WHEN regexp_matches(c, '[.!?][\s"'')\]]*$') AND n >= 4 THEN 'sentence' END AS target_fault
 FROM (SELECT conv_id, turn, trim(split_part(text, ',', 1)) AS c, len(regexp_split_to_array(trim(split_part(text, ',', 1)), '\s+')) AS n FROM conversations)""")
def term_caps(spark, d):
    c = F.split_part("text", F.lit(","), F.lit(1))
    return tab(spark, d, "conversations").select("conv_id", "turn", T.cap_violation(c).alias("source_fault"), T.cap_violation(c, target=True).alias("target_fault"))


@query("""SELECT doc_id, CASE WHEN length(t) > 60 THEN left(t, 59) || '…' ELSE t END AS preview FROM (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)""")
def preview_truncate(spark, d):
    return tab(spark, d, "documents").select("doc_id", T.preview(F.col("text"), 60).alias("preview"))


@query("""SELECT conv_id, turn, '[mock-tr] ' || text AS content, CAST(greatest(1, ceil(length(text) / 4.0)) AS BIGINT) AS prompt_tokens,
 CAST(greatest(1, ceil((length(text) + 10) / 4.0)) AS BIGINT) AS completion_tokens FROM conversations""")
def mock_chat(spark, d):
    return tab(spark, d, "conversations").select("conv_id", "turn", ledger.mock_chat(F.col("text")).alias("x")).select("conv_id", "turn", "x.content", "x.prompt_tokens", "x.completion_tokens")


# context windows and folds


@query("""WITH c AS (SELECT a.conv_id, a.turn, b.turn AS bt, length(b.text) AS n, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS k,
 sum(length(b.text)) OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS run FROM conversations a JOIN conversations b
 ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 12 WHERE trim(b.text) <> ''),
 ok AS (SELECT * FROM c WHERE k <= 3 AND (k = 1 OR run <= 400))
 SELECT a.conv_id, a.turn, CAST(count(ok.k) AS INTEGER) AS n_context, CAST(coalesce(sum(ok.n), 0) AS BIGINT) AS chars FROM conversations a LEFT JOIN ok USING (conv_id, turn) GROUP BY a.conv_id, a.turn""")
def prev_context(spark, d):
    c = context.previous(tab(spark, d, "conversations"), "conv_id", "turn", "text", most=3, budget=400)
    chars = F.aggregate("context", F.lit(0).cast("bigint"), lambda a, x: a + F.length(x["t"]))
    return c.select("conv_id", "turn", F.size("context").alias("n_context"), chars.alias("chars"))


@query("""WITH RECURSIVE o AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS i, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS t FROM documents),
 f AS (SELECT source, i, 0 AS chunk, t AS run FROM o WHERE i = 1 UNION ALL SELECT o.source, o.i, CASE WHEN f.run + o.t > 1500 THEN f.chunk + 1 ELSE f.chunk END,
 CASE WHEN f.run + o.t > 1500 THEN o.t ELSE f.run + o.t END FROM f JOIN o ON o.source = f.source AND o.i = f.i + 1)
 SELECT source, chunk, CAST(count(*) AS INTEGER) AS n, max(run) AS tokens FROM f GROUP BY source, chunk""")
def chunk_packing(spark, d):
    return context.chunks(tab(spark, d, "documents"), "source", "doc_id", "text", 1500)


@query("""WITH RECURSIVE o AS (SELECT row_number() OVER (ORDER BY doc_id) AS i, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS t FROM documents),
 f AS (SELECT i, 0 AS chunk, t AS run FROM o WHERE i = 1 UNION ALL SELECT o.i, CASE WHEN f.run + o.t > 4000 THEN f.chunk + 1 ELSE f.chunk END,
 CASE WHEN f.run + o.t > 4000 THEN o.t ELSE f.run + o.t END FROM f JOIN o ON o.i = f.i + 1)
 SELECT 'all' AS book, chunk, CAST(count(*) AS INTEGER) AS n, max(run) AS tokens FROM f GROUP BY chunk""")
def chunk_packing_one_group(spark, d):
    return context.chunks(tab(spark, d, "documents").withColumn("book", F.lit("all")), "book", "doc_id", "text", 4000)


@query()
def prose_chunks(spark, d):
    return harvest.prose_chunks(tab(spark, d, "documents"), "source", "doc_id", "text", 1200)


@query("""WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS p, count(*) OVER (PARTITION BY source) AS n FROM documents),
 q AS (SELECT *, n - 7 AS zone, greatest(1, (n - 7) // 4) AS step FROM p)
 SELECT source, doc_id, CASE WHEN p < 5 THEN 'head' WHEN p >= n - 2 THEN 'tail' ELSE 'middle' END AS part FROM q
 WHERE p < 5 OR p >= n - 2 OR (zone >= 4 AND (p - 4) % step = 0 AND (p - 4) / step <= 3)""")
def spread_sample(spark, d):
    return context.spread(tab(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("""SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS fails, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w >= 10 AND count(*) OVER w >= 10 AS tripped
 FROM events WINDOW w AS (PARTITION BY user_id % 4 ORDER BY event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)""")
def sliding_breaker(spark, d):
    e = tab(spark, d, "events").withColumn("g", F.col("user_id") % 4)
    return context.sliding_failures(e, "g", "event_id", F.col("event_type") == "error").select("event_id", "fails", "tripped")


@query("""SELECT g, count(*) AS n, round(max(spent), 4) AS spent FROM (SELECT *, coalesce(max(spent) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM (SELECT user_id % 4 AS g, event_id, sum(value) OVER (PARTITION BY user_id % 4 ORDER BY event_id) AS spent FROM events)) WHERE before <= 1000 GROUP BY g""")
def budget_cutoff(spark, d):
    e = tab(spark, d, "events").withColumn("g", F.col("user_id") % 4)
    return context.within_budget(e, "g", "event_id", "value", 1000.0).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("spent"), 4).alias("spent"))


@query("""SELECT g, min(event_id) AS first_seq, count(*) AS n FROM (SELECT user_id % 4 AS g, event_id, event_type,
 row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - row_number() OVER (PARTITION BY user_id % 4, event_type = 'error' ORDER BY event_id) AS k FROM events)
 WHERE event_type = 'error' GROUP BY g, k HAVING count(*) >= 3""")
def failure_streaks(spark, d):
    e = tab(spark, d, "events").withColumn("g", F.col("user_id") % 4)
    return context.streaks(e, "g", "event_id", F.col("event_type") == "error")


@query("SELECT o_orderkey, CAST(least(8, greatest(1, (o_custkey % 40) // 2)) AS INTEGER) AS cap FROM orders")
def concurrency_cap(spark, d):
    return tab(spark, d, "orders").select("o_orderkey", context.concurrency(F.lit(8), F.col("o_custkey") % 40).alias("cap"))


# glossary

@query(f"""SELECT p.p_partkey, CASE WHEN g.source_term IS NULL THEN 'created' ELSE 'skipped' END AS outcome FROM part p LEFT JOIN
 (SELECT DISTINCT p_name AS source_term, p_type AS type FROM part WHERE p_partkey % 7 = 0) g ON p.p_name = g.source_term AND p.p_type = g.type""")
def import_classify(spark, d):
    p = tab(spark, d, "part").select("p_partkey", F.col("p_name").alias("source_term"), F.col("p_type").alias("type"))
    return glossary.classify_import(p, p.where("p_partkey % 7 = 0"), overwrite=False).select("p_partkey", "outcome")


PROPOSED = """(SELECT p_partkey AS seq, CASE p_partkey % 4 WHEN 0 THEN w WHEN 1 THEN upper(w) WHEN 2 THEN w || ' Company' ELSE 'The ' || w END AS source, CASE WHEN p_size % 3 = 0 THEN reverse(w) WHEN p_size % 3 = 1 THEN w END AS target,
 CASE WHEN p_size % 4 = 0 THEN 'place' ELSE 'other' END AS type FROM (SELECT *, split_part(p_name, ' ', 1) || p_partkey % 37 AS w FROM part))"""
KNOWN = """(SELECT 'e' || p_partkey AS id, w AS source_term, CASE WHEN p_size % 2 = 0 THEN w ELSE reverse(w) END AS target_term, 'term' AS type, CASE WHEN p_size % 5 = 0 THEN 'confirmed' ELSE 'proposed' END AS status
 FROM (SELECT *, split_part(p_name, ' ', 1) || p_partkey % 37 AS w FROM part WHERE p_partkey % 9 = 0))"""
RESOLVED = f"""p AS (SELECT seq, regexp_replace(source, '^The ', '') AS term, CASE WHEN target <> regexp_replace(source, '^The ', '') THEN target END AS target, CASE type WHEN 'place' THEN type ELSE 'term' END AS type,
 regexp_replace(lower(regexp_replace(source, '^The ', '')), ' company$', '') AS canon FROM {PROPOSED}), e AS (SELECT *, lower(source_term) AS canon FROM {KNOWN}),
 x AS (SELECT source_term, min(id) AS x_id FROM e GROUP BY source_term), a AS (SELECT canon, arg_min(id, (source_term, id)) AS a_id FROM e GROUP BY canon), f AS (SELECT canon, min(seq) AS s, arg_min(term, seq) AS t FROM p GROUP BY canon),
 r AS (SELECT p.*, coalesce(x_id, a_id, 'p' || s) AS entry_id, CASE WHEN x_id IS NOT NULL THEN 'exact' WHEN a_id IS NOT NULL THEN 'canonical' WHEN s = seq THEN 'created' WHEN t = term THEN 'exact' ELSE 'canonical' END AS how
 FROM p LEFT JOIN x ON p.term = x.source_term LEFT JOIN a USING (canon) JOIN f USING (canon))"""


def proposed_rows(spark, d):
    """Parts as proposals of a translation and, every ninth of them, as the glossary they meet."""
    w = F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), (F.col("p_partkey") % 37).cast("string"))
    p = tab(spark, d, "part").withColumn("w", w)
    k, n = F.col("p_partkey") % 4, F.col("p_size") % 3
    source = F.when(k == 0, F.col("w")).when(k == 1, F.upper("w")).when(k == 2, F.concat("w", F.lit(" Company"))).otherwise(F.concat(F.lit("The "), "w"))
    raw = p.select(F.col("p_partkey").alias("seq"), F.lit("s").alias("segment_id"), source.alias("source"), F.when(n == 0, F.reverse("w")).when(n == 1, F.col("w")).alias("target"), F.when(F.col("p_size") % 4 == 0, "place").otherwise("other").alias("type"), F.lit("").alias("evidence"))
    e = p.where("p_partkey % 9 = 0").select(
        F.concat(F.lit("e"), F.col("p_partkey").cast("string")).alias("id"), F.col("w").alias("source_term"), F.when(F.col("p_size") % 2 == 0, F.col("w")).otherwise(F.reverse("w")).alias("target_term"), F.lit("term").alias("type"),
        F.when(F.col("p_size") % 5 == 0, "confirmed").otherwise("proposed").alias("status"), F.array().cast("array<string>").alias("source_aliases"),
    )
    return proposals.resolve(proposals.candidates(raw), e, "en", "en"), e


@query(f"WITH {RESOLVED} SELECT seq, entry_id, how, term, type FROM r")
def proposals_resolved(spark, d):
    return proposed_rows(spark, d)[0].select("seq", "entry_id", "how", "term", "type")


@query(f"""WITH {RESOLVED}, b AS (SELECT id, source_term, target_term, type, status FROM e UNION ALL SELECT entry_id, term, coalesce(target, term), type, 'proposed' FROM r WHERE how = 'created')
 SELECT b.id, b.source_term, CASE WHEN b.status = 'proposed' AND b.target_term = b.source_term THEN coalesce(arg_min(r.target, r.seq) FILTER (r.target IS NOT NULL AND r.target <> b.source_term), b.target_term) ELSE b.target_term END AS target_term,
 CASE WHEN b.status = 'proposed' AND b.type = 'term' THEN coalesce(arg_min(r.type, r.seq) FILTER (r.type <> 'term'), b.type) ELSE b.type END AS type, b.status,
 coalesce(list(DISTINCT r.term ORDER BY r.term) FILTER (r.how = 'canonical' AND lower(r.term) <> lower(b.source_term)), []::VARCHAR[]) AS source_aliases
 FROM b JOIN r ON r.entry_id = b.id GROUP BY b.id, b.source_term, b.target_term, b.type, b.status""")
def proposals_applied(spark, d):
    return proposals.applied(*proposed_rows(spark, d))


# cache, prices


@query("""SELECT conv_id, turn, sha256('m:' || sha256('sys') || ':' || sha256(role || chr(0) || text) || ':' || repeat('0', 32)) AS key FROM conversations""")
def cache_key(spark, d):
    c = tab(spark, d, "conversations")
    h = ledger.message_hash(F.array(F.struct(F.lit("system").alias("role"), F.lit("sys").alias("content")), F.struct(F.when(F.col("role") == "system", "user").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"))))
    h = F.when(F.col("role") == "system", ledger.message_hash(F.array(F.struct(F.lit("system").alias("role"), F.lit("sys").alias("content"))))["usr"]).otherwise(h["usr"])
    usr = F.when(F.col("role") == "system", F.sha2(F.concat(F.lit("system"), F.lit("\u0000"), F.col("text")), 256)).otherwise(h)
    return c.select("conv_id", "turn", ledger.cache_key(F.lit("m"), F.sha2(F.lit("sys"), 256), usr, F.lit("0" * 32)).alias("key"))


@query("""SELECT e.event_id, h.hit_id, CASE WHEN h.hit_id IS NULL THEN 0 ELSE 1 END AS cache_hit, CASE WHEN h.hit_id IS NULL THEN e.value ELSE 0 END AS cost FROM events e LEFT JOIN
 (SELECT user_id, arg_min(event_id, event_id) AS hit_id FROM events WHERE event_type = 'purchase' GROUP BY user_id) h ON e.user_id = h.user_id""")
def cache_hits_join(spark, d):
    e = tab(spark, d, "events")
    req = e.select("event_id", F.col("user_id").alias("cache_key"), F.col("value").alias("price"))
    calls = e.select(F.col("event_id").alias("call_id"), F.col("event_id").alias("created_at"), F.col("user_id").alias("cache_key"), F.col("value").alias("cost"), (F.col("event_type") == "purchase").alias("ok"))
    return ledger.replay(req, calls).select("event_id", "hit_id", "cache_hit", "cost")


@query("SELECT l_orderkey, l_linenumber, round((l_quantity * 3 + l_partkey * 6) / 1e6, 9) AS cost FROM lineitem")
def cost_estimate(spark, d):
    p = ledger.priced(values(spark, "(VALUES ('gpt-large-2024-05-01')) AS m(model)"), values(spark, PRICES))
    li = tab(spark, d, "lineitem").join(F.broadcast(p))  # one model, one row
    return li.select("l_orderkey", "l_linenumber", F.round(ledger.cost(F.col("l_quantity"), F.col("l_partkey"), F.col("prompt_price"), F.col("completion_price")), 9).alias("cost"))


# keyed tables


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1")
def upsert_keep_latest(spark, d):
    o = tab(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return tables.upsert(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_name END AS s_name, CASE WHEN s_suppkey % 5 = 0 THEN s_acctbal ELSE s_acctbal END AS s_acctbal FROM supplier")
def partial_update(spark, d):
    s = tab(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    ch = s.where("s_suppkey % 5 = 0").select("s_suppkey", F.lit(None).cast("string").alias("s_name"), F.lit(1.0).alias("s_acctbal"), F.lit(True).alias("set_s_name"), F.lit(False).alias("set_s_acctbal"))
    return tables.patch(s, ch, "s_suppkey", ["s_name", "s_acctbal"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def delete_cascade(spark, d):
    return tables.delete(tab(spark, d, "lineitem").select("l_orderkey", "l_linenumber"), tab(spark, d, "orders").where("o_orderstatus = 'F'"), "l_orderkey", "o_orderkey")


@query("SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name FROM nation")
def replace_set(spark, d):
    n = tab(spark, d, "nation").select("n_regionkey", "n_nationkey", "n_name")
    new = n.where("n_regionkey = 1").withColumn("n_name", F.upper("n_name"))
    return tables.replace_set(n, new, new.select("n_regionkey").distinct(), "n_regionkey").select("n_nationkey", "n_name")


@query("SELECT s_suppkey, s_acctbal AS old_s_acctbal, s_acctbal + 1 AS new_s_acctbal FROM supplier WHERE s_suppkey % 3 = 0")
def revision_log(spark, d):
    s = tab(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    new = s.withColumn("s_acctbal", F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal") + 1).otherwise(F.col("s_acctbal"))).withColumn("s_name", F.lower("s_name"))
    return tables.changed(s, new, "s_suppkey", ["s_name", "s_acctbal"], ["s_acctbal"])[1]


@query("SELECT n_nationkey, coalesce(r_regionkey + 100, n_regionkey) AS n_regionkey FROM nation LEFT JOIN (SELECT * FROM region WHERE r_regionkey < 3) ON n_regionkey = r_regionkey")
def id_remap(spark, d):
    ids = tab(spark, d, "region").where("r_regionkey < 3").select(F.col("r_regionkey").alias("old_id"), (F.col("r_regionkey") + 100).alias("new_id"))
    return tables.remap(tab(spark, d, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", ids)


@query("SELECT event_id FROM events ORDER BY event_id DESC LIMIT 50")
def ring_buffer(spark, d):
    return tables.keep_last(tab(spark, d, "events").select("event_id"), "event_id", 50)


@query("SELECT doc_id, source, idx FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents) WHERE source IN ('src1', 'src2') AND idx >= 3 AND idx < 9")
def index_range_scan(spark, d):
    return chapters(tab(spark, d, "documents")).where("chapter in ('src1', 'src2') and idx >= 3 and idx < 9").select("doc_id", F.col("chapter").alias("source"), "idx")


@query(f"SELECT doc_id, CASE WHEN status <> 'pending' AND length(target_text) > 0 THEN target_text ELSE source_text END AS text FROM {SEGMENTS}")
def export_projection(spark, d):
    s = segments(spark, d)
    return s.select("doc_id", F.when((F.col("status") != "pending") & (F.length("target_text") > 0), F.col("target_text")).otherwise(F.col("source_text")).alias("text"))


@query("SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def reassemble_parts(spark, d):
    g = tab(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return g.select("conv_id", F.array_join(F.transform("x", lambda p: p["text"]), " ").alias("text"))


@query("SELECT event_id, event_type IN ('click', 'view') AND (user_id % 5 = 1 OR user_id % 5 = 0 OR 100000 - event_id > 95000) AS claim FROM events")
def resume_claim(spark, d):
    e = tab(spark, d, "events").select("event_id", F.when(F.col("event_type").isin("click", "view"), "running").otherwise("done").alias("status"), F.when(F.col("user_id") % 5 == 0, None).otherwise((F.col("user_id") % 5).cast("string")).alias("owner"), F.col("event_id").alias("heartbeat"))
    return e.select("event_id", F.coalesce(tables.claimable("1", 100000, 95000), F.lit(False)).alias("claim"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN s_name WHEN s_suppkey % 3 = 1 THEN 'library' ELSE 'default' END AS model FROM supplier")
def layered_config(spark, d):
    k = F.col("s_suppkey") % 3
    return tab(spark, d, "supplier").select("s_suppkey", T.first_set(F.when(k == 0, F.col("s_name")).otherwise("  "), F.when(k == 1, "library"), F.lit("default")).alias("model"))


# sources


@query()
def html_segments(spark, d):
    from folioscope.sources import markup

    return markup.segments(tab(spark, d, "pages"), "page_id", "html", budget=200)


@query()
def mock_embeddings(spark, d):
    from folioscope.sources import models

    return models.embed(tab(spark, d, "benchmark"), "item_id", "text")


# reading order and bookkeeping


RUNS = """(SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'extract' ELSE 'summary' END AS kind, CAST(o_custkey AS VARCHAR) AS chapter_id, o_orderdate AS started_at FROM orders)"""
MENTIONS = "(SELECT l_orderkey AS segment_id, l_suppkey % 3 AS entry_id, l_linenumber % 2 AS start, CAST(l_quantity AS BIGINT) % 2 AS \"end\", l_shipdate AS created_at, l_linenumber AS id FROM lineitem)"


def mention_rows(spark, d):
    q = F.col("l_quantity").cast("bigint") % 2
    return tab(spark, d, "lineitem").select(F.col("l_orderkey").alias("segment_id"), (F.col("l_suppkey") % 3).alias("entry_id"), (F.col("l_linenumber") % 2).alias("start"), q.alias("end"), F.col("l_shipdate").alias("created_at"), F.col("l_linenumber").alias("id"))


def segment_rows(spark, d):
    """Orders as segments of chapters that are customers; the chapters' places come from their nations, some have none."""
    o = tab(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "pending").otherwise("translated")
    s = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("chapter_id"), (F.col("o_orderkey") % 1000).alias("idx"), status.alias("status"))
    c = tab(spark, d, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("spine_idx"))
    return s, c


PENDING = """(SELECT o_orderkey AS id, o_custkey AS chapter_id, o_orderkey % 1000 AS idx, 'pending' AS status, coalesce(c.c_nationkey, 0) AS spine_idx FROM orders o
 LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 7 <> 0) c ON o.o_custkey = c.c_custkey WHERE o_orderstatus = 'O')"""


@query(f"SELECT id, chapter_id, idx, spine_idx, row_number() OVER (PARTITION BY chapter_id ORDER BY spine_idx, idx, id) AS place FROM {PENDING}")
def pending_in_order(spark, d):
    p = reading.pending_in_order(*segment_rows(spark, d))
    return p.select("id", "chapter_id", "idx", "spine_idx", F.row_number().over(W.partitionBy("chapter_id").orderBy(*reading.reading_order(), "id")).cast("bigint").alias("place"))


@query(f"SELECT id, chapter_id FROM {PENDING} WHERE chapter_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def pending_of_chapters(spark, d):
    only = tab(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("chapter_id"))
    return reading.pending_in_order(*segment_rows(spark, d), only).select("id", "chapter_id")


@query(f"SELECT id, chapter_id, idx FROM {PENDING} ORDER BY spine_idx, idx, id LIMIT 30")
def initial_segments(spark, d):
    return reading.initial(reading.pending_in_order(*segment_rows(spark, d))).select("id", "chapter_id", "idx")


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text ELSE ' ' END AS pov, CASE WHEN role = 'assistant' THEN text END AS tense, CASE WHEN role = 'system' THEN text END AS note FROM conversations)
 SELECT conv_id, arg_min(pov, turn) FILTER (trim(pov) <> '') AS pov, arg_min(tense, turn) FILTER (trim(tense) <> '') AS tense,
 coalesce(list(trim(note) ORDER BY turn) FILTER (trim(note) <> ''), []::VARCHAR[]) AS notes FROM r GROUP BY conv_id""")
def first_set_fold(spark, d):
    r = tab(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("text")).otherwise(" ").alias("pov"), F.when(F.col("role") == "assistant", F.col("text")).alias("tense"), F.when(F.col("role") == "system", F.col("text")).alias("note"))
    return reading.first_set(r, "conv_id", "turn", ["pov", "tense"], "note")


@query(f"SELECT segment_id, entry_id, start, \"end\", id FROM {MENTIONS} QUALIFY row_number() OVER (PARTITION BY segment_id, entry_id, start, \"end\" ORDER BY created_at, id) = 1")
def mention_dedupe(spark, d):
    return reading.distinct_mentions(mention_rows(spark, d)).select("segment_id", "entry_id", "start", "end", "id")


@query("""WITH o AS (SELECT conv_id AS id, text FROM conversations WHERE role = 'user'), n AS (SELECT conv_id AS id, CASE WHEN turn % 3 = 0 THEN text || '!' ELSE text END AS text FROM conversations WHERE turn > 0),
 k AS (SELECT id FROM o UNION SELECT id FROM n), e AS (SELECT []::VARCHAR[] AS none)
 SELECT k.id, coalesce((SELECT list(DISTINCT text ORDER BY text) FROM n WHERE n.id = k.id AND text NOT IN (SELECT text FROM o WHERE o.id = k.id)), none) AS added,
 coalesce((SELECT list(DISTINCT text ORDER BY text) FROM o WHERE o.id = k.id AND text NOT IN (SELECT text FROM n WHERE n.id = k.id)), none) AS removed,
 coalesce((SELECT list(DISTINCT text ORDER BY text) FROM o WHERE o.id = k.id AND text IN (SELECT text FROM n WHERE n.id = k.id)), none) AS kept FROM k, e""")
def alias_changes(spark, d):
    c = tab(spark, d, "conversations")
    old = c.where("role = 'user'").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list("text").alias("aliases"))
    new = c.where("turn > 0").groupBy(F.col("conv_id").alias("id")).agg(F.collect_list(F.when(F.col("turn") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).alias("aliases"))
    return reading.alias_changes(old, new)


@query("SELECT p_partkey AS id, CASE WHEN p_size < 20 THEN p_name ELSE upper(p_name) END AS term FROM part")
def augmented_glossary(spark, d):
    p = tab(spark, d, "part")
    base = p.where("p_size < 20").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("term"))
    fresh = p.select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("term"))
    return reading.augmented(base, fresh.unionByName(fresh))


@query(f"SELECT id, kind, chapter_id FROM {RUNS} WHERE kind = 'extract' ORDER BY started_at DESC, id LIMIT 40")
def intake_run_list(spark, d):
    o = tab(spark, d, "orders")
    r = o.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "extract").otherwise("summary").alias("kind"), F.col("o_custkey").cast("string").alias("chapter_id"), F.col("o_orderdate").alias("started_at"))
    return reading.intake_runs(r, "extract", limit=40).select("id", "kind", "chapter_id")


@query("""SELECT count(*) AS runs, CAST(sum(l_linenumber) AS BIGINT) AS chunks, CAST(sum(l_linenumber // 2) AS BIGINT) AS cached_chunks, CAST(sum(l_suppkey) AS BIGINT) AS proposed, CAST(sum(l_linenumber % 2) AS BIGINT) AS failed,
 CAST(sum(l_partkey) AS BIGINT) AS prompt_tokens, CAST(sum(l_orderkey) AS BIGINT) AS completion_tokens, round(sum(l_discount), 6) AS cost FROM lineitem""")
def intake_totals(spark, d):
    li = tab(spark, d, "lineitem")
    n = F.col("l_linenumber")
    return reading.intake_totals(li.select(n.alias("chunks"), F.expr("l_linenumber div 2").alias("cached_chunks"), F.col("l_suppkey").alias("proposed"), (n % 2).alias("failed"), F.col("l_partkey").alias("prompt_tokens"), F.col("l_orderkey").alias("completion_tokens"), F.col("l_discount").alias("cost")))


@query("""SELECT conv_id, nullif(coalesce(string_agg(trim(text), chr(10) || chr(10) ORDER BY turn) FILTER (role = 'assistant' AND trim(text) <> ''), ''), '') AS notes FROM conversations GROUP BY conv_id""")
def run_record(spark, d):
    n = tab(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("role") == "assistant", F.col("text")).alias("note"))
    return reading.run_record(n, "conv_id", "turn", "note")


@query("SELECT (SELECT max(event_id) FROM events) + row_number() OVER (ORDER BY s_acctbal, s_suppkey) AS event_id, s_suppkey, s_acctbal FROM supplier")
def append_events(spark, d):
    return reading.appended(tab(spark, d, "events"), tab(spark, d, "supplier").select("s_suppkey", "s_acctbal"), "event_id", ["s_acctbal", "s_suppkey"])


VECTORS = "(SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'segment' ELSE 'entry' END AS scope, l_partkey AS ref_id, CASE WHEN l_linenumber < 3 THEN 'new' ELSE 'old' END AS model FROM lineitem)"


def vector_rows(spark, d):
    li = tab(spark, d, "lineitem")
    return li.select(F.when(F.col("l_suppkey") % 2 == 0, "segment").otherwise("entry").alias("scope"), F.col("l_partkey").alias("ref_id"), F.when(F.col("l_linenumber") < 3, "new").otherwise("old").alias("model"))


@query(f"""SELECT scope, CAST(sum(n) AS BIGINT) AS "rows", count(*) AS refs, count(*) FILTER (active) AS active, count(*) FILTER (NOT active) AS stale FROM
 (SELECT scope, ref_id, count(*) AS n, bool_or(model = 'new') AS active FROM {VECTORS} GROUP BY scope, ref_id) GROUP BY scope""")
def embedding_inventory(spark, d):
    return retrieval.inventory(vector_rows(spark, d), F.lit("new"))


@query(f"SELECT scope, ref_id, count(*) AS n FROM {VECTORS} v WHERE model = 'old' AND EXISTS (SELECT 1 FROM {VECTORS} w WHERE w.model = 'new' AND w.scope = v.scope AND w.ref_id = v.ref_id) GROUP BY scope, ref_id")
def purge_stale_vectors(spark, d):
    return reading.stale_vectors(vector_rows(spark, d), "new").groupBy("scope", "ref_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT DISTINCT scope, ref_id FROM {VECTORS} v WHERE NOT EXISTS (SELECT 1 FROM {VECTORS} w WHERE w.model = 'new' AND w.scope = v.scope AND w.ref_id = v.ref_id)")
def references_to_embed(spark, d):
    v = vector_rows(spark, d)
    return reading.to_embed(v.select("scope", "ref_id").distinct(), v, "new")


@query("""WITH o AS (SELECT 'doc' AS scope, CAST(s_suppkey AS VARCHAR) AS ref_id, 'm' AS model, 'old-' || s_suppkey AS id, s_acctbal AS created_at, s_nationkey AS dim FROM supplier WHERE s_suppkey % 3 > 0),
 n AS (SELECT 'doc' AS scope, CAST(s_suppkey AS VARCHAR) AS ref_id, 'm' AS model, 'new-' || s_suppkey AS id, s_acctbal + 1 AS created_at, s_nationkey + 100 AS dim FROM supplier WHERE s_suppkey % 3 < 2)
 SELECT scope, ref_id, model, coalesce(o.id, n.id) AS id, coalesce(o.created_at, n.created_at) AS created_at, coalesce(n.dim, o.dim) AS dim FROM o FULL JOIN n USING (scope, ref_id, model)""")
def embedding_upsert(spark, d):
    s = tab(spark, d, "supplier")
    rows = lambda name, bal, dim: s.select("s_suppkey", F.lit("doc").alias("scope"), F.col("s_suppkey").cast("string").alias("ref_id"), F.lit("m").alias("model"), F.concat(F.lit(name + "-"), F.col("s_suppkey").cast("string")).alias("id"), bal.alias("created_at"), dim.alias("dim"))
    old = rows("old", F.col("s_acctbal"), F.col("s_nationkey")).where("s_suppkey % 3 > 0").drop("s_suppkey")
    new = rows("new", F.col("s_acctbal") + 1, F.col("s_nationkey") + 100).where("s_suppkey % 3 < 2").drop("s_suppkey")
    return tables.embedding_upsert(old, new)


# the batch chain


@query(f"""SELECT s.doc_id, g.id AS entry_id, CASE WHEN g.status = 'locked' AND g.source_known THEN 'error' ELSE 'warning' END AS severity
 FROM {SEGMENTS} s, {duck(GLOSSARY)} WHERE g.status <> 'proposed' AND g.source_term IS NOT NULL AND {_hits('g.source_term', 's.source_text')} > 0 AND {_hits('g.target_term', 's.target_text')} = 0
 UNION ALL SELECT doc_id, NULL, 'warning' FROM (SELECT doc_id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT doc_id, list_transform(regexp_extract_all(target_text, '\\p{{L}}+(?:''\\p{{L}}+)?'), lambda x: lower(x)) AS ws FROM {SEGMENTS}))
 WHERE ws[i] = ws[i + 1] AND ws[i] IN ('der','die','das','den','dem','des','ein','eine','einen','einem','einer','eines','in','an','auf','zu','von','mit','bei','im','am','zum','zur','vom','beim')""")
def all_violations(spark, d):
    s = segments(spark, d)
    g = values(spark, GLOSSARY).withColumn("target_aliases", F.array().cast("array<string>"))
    return matching.violations(s, g).unionByName(batch.doubled(s, "de", "doc_id"))


@query("""WITH o AS (SELECT user_id, event_id, event_type, value, row_number() OVER w AS n, sum(value) OVER w AS spent FROM events WINDOW w AS (ORDER BY user_id, event_id ROWS UNBOUNDED PRECEDING)),
 f AS (SELECT n, lag(n, 4) OVER (ORDER BY n) AS z FROM o WHERE event_type = 'error'),
 e AS (SELECT least(coalesce((SELECT min(n) FROM f WHERE n - z < 8), 1e12), coalesce((SELECT min(n) FROM o WHERE spent > 20000), 1e12)) AS last)
 SELECT user_id, event_id FROM o, e WHERE n <= last""")
def batch_ends(spark, d):
    e = tab(spark, d, "events").select("user_id", "event_id", "value", "event_type")
    return batch.until(e, "user_id", "event_id", "value", F.col("event_type") == "error", 20000.0, 8, 5).select("user_id", "event_id")


# chained summaries


_SUMMARY = "CASE WHEN length({u}) % 7 <> 0 THEN '[mock-sum] ' || left(sha256({u}), 16) || ' ' || right({u}, 40) END"
_ASKED = "concat_ws(chr(10) || chr(10), 'Summary so far:' || chr(10) || {prior}, 'Next part:' || chr(10) || o.t)"
SQL_CHAIN = f"""WITH RECURSIVE o AS (SELECT conv_id, turn, trim(text) AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS part FROM conversations WHERE trim(text) <> ''),
 f AS (SELECT conv_id, turn, part, CAST(NULL AS VARCHAR) AS prior, {_ASKED.format(prior='NULL')} AS u FROM o WHERE part = 1 UNION ALL
 SELECT o.conv_id, o.turn, o.part, coalesce({_SUMMARY.format(u='f.u')}, f.prior), {_ASKED.format(prior=f"coalesce({_SUMMARY.format(u='f.u')}, f.prior)")} FROM f JOIN o ON o.conv_id = f.conv_id AND o.part = f.part + 1),
 c AS (SELECT conv_id, turn, part, prior, sha256('m:' || sha256('summarize') || ':' || sha256('user' || chr(0) || u) || ':' || repeat('0', 32)) AS cache_key, {_SUMMARY.format(u='u')} AS summary FROM f)"""


def _chain(spark, d, calls=None):
    """Conversations as books and turns as their parts; the model fails on every seventh length of a request."""
    reply = lambda u: F.when(F.length(u) % 7 != 0, F.concat(F.lit("[mock-sum] "), F.substring(F.sha2(u, 256), 1, 16), F.lit(" "), F.right(u, F.lit(40))))
    return summaries.chained(tab(spark, d, "conversations"), "conv_id", "turn", "text", reply, "m", "0" * 32, calls)


@query(f"{SQL_CHAIN} SELECT conv_id, turn, part, prior, cache_key, CASE WHEN summary IS NULL THEN 'failed' ELSE 'called' END AS status, summary FROM c")
def chained_summaries(spark, d):
    return _chain(spark, d)


@query(f"""{SQL_CHAIN} SELECT conv_id, count(*) AS parts, count(summary) AS cached, count(*) - count(summary) AS failed, arg_max(summary, part) FILTER (summary IS NOT NULL) AS summary,
 CASE WHEN count(summary) = 0 THEN 'all summary chunks failed' END AS error FROM c GROUP BY conv_id""")
def book_summaries(spark, d):
    """A second reading of every book, which takes all replies of the first from the ledger."""
    return summaries.of_books(_chain(spark, d, summaries.as_calls(_chain(spark, d))), "conv_id")


# live views, read to the end of the table


def log_stream(spark, d):
    return live.events(spark, f"{d}/events.parquet*", tab(spark, d, "events").schema)


@query("SELECT event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY event_type")
def live_kind_totals(spark, d):
    return live.run_through(live.kind_totals(log_stream(spark, d)), "complete", "event_type").withColumn("value", F.round("value", 4))


@query("""SELECT user_id % 7 AS g, count(*) AS seen, CAST(sum(CASE WHEN back <= 20 THEN bad END) AS BIGINT) AS fails, max(n_bad) >= 5 AS tripped FROM (
 SELECT *, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id DESC) AS back, CASE WHEN row_number() OVER w >= 5 THEN sum(bad) OVER (w ROWS 19 PRECEDING) END AS n_bad
 FROM (SELECT *, CAST(event_type = 'error' AS INTEGER) AS bad FROM events) WINDOW w AS (PARTITION BY user_id % 7 ORDER BY event_id)) GROUP BY user_id % 7""")
def live_breaker(spark, d):
    log = log_stream(spark, d).withColumn("g", F.col("user_id") % 7)
    return live.run_through(live.breaker(log, "g", "event_id", F.col("event_type") == "error", 20, 5), "update", "g")


@query("SELECT DISTINCT user_id FROM events")
def live_once(spark, d):
    return live.run_through(live.once(log_stream(spark, d).select("user_id", "ts"), ["user_id"], within="3650 days"), "append", "user_id").select("user_id")


def inbox_log(log: DataFrame) -> DataFrame:
    """Events as changes of the status of a user's segment; errors bring the note of a flag."""
    status = F.when(F.col("event_type").isin("signup", "click"), "flagged").when(F.col("event_type") == "purchase", "approved").when(F.col("event_type") == "view", "pending")
    return log.select("user_id", "event_id", status.alias("status"), F.when(F.col("event_type") == "error", F.col("props")).alias("note"))


@query("""SELECT user_id, note FROM (SELECT user_id, arg_max(event_type, event_id) FILTER (event_type <> 'error') AS t, arg_max(props, event_id) FILTER (event_type = 'error') AS note
 FROM events GROUP BY user_id) WHERE t IN ('signup', 'click')""")
def live_inbox(spark, d):
    return live.run_through(live.inbox(inbox_log(log_stream(spark, d)), "user_id", "event_id", "status", "note"), "update", "user_id").where("shown").select("user_id", "note")


def run_log(log: DataFrame) -> DataFrame:
    """Events as the log of fifty batch runs with markers among them."""
    n, kinds = F.col("event_id"), {"purchase": "translated", "click": "cached", "view": "flagged", "error": "failed"}
    kind = F.when(n % 401 == 0, live.CANCELLED).when(n % 37 == 0, live.PAUSED).when(n % 37 == 5, live.RESUMED)
    for name, outcome in kinds.items():
        kind = kind.when(F.col("event_type") == name, outcome)
    return log.select((F.col("user_id") % 50).alias("run"), "event_id", kind.alias("kind"), F.floor(F.abs("value") * 10).alias("ms"))


def run_baseline(spark, d) -> DataFrame:
    """What was done of the runs elsewhere: a run for each customer."""
    zero = F.lit(0).cast("bigint")
    return tab(spark, d, "customer").select(F.col("c_custkey").alias("run"), F.col("c_nationkey").alias("translated"), zero.alias("cached"), zero.alias("flagged"), F.lit(1).alias("failed"), (F.col("c_nationkey") * 1000).alias("elapsed_ms"))


@query("""WITH o AS (SELECT user_id % 50 AS run, event_id AS seq, CAST(floor(abs(value) * 10) AS BIGINT) AS ms, CASE WHEN event_id % 401 = 0 THEN 'cancelled' WHEN event_id % 37 = 0 THEN 'paused'
 WHEN event_id % 37 = 5 THEN 'resumed' ELSE CASE event_type WHEN 'purchase' THEN 'translated' WHEN 'click' THEN 'cached' WHEN 'view' THEN 'flagged' WHEN 'error' THEN 'failed' END END AS kind FROM events),
 m AS (SELECT *, min(CASE WHEN kind = 'cancelled' THEN seq END) OVER (PARTITION BY run) AS c, last_value(CASE WHEN kind IN ('paused', 'resumed') THEN kind END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS p FROM o),
 x AS (SELECT *, kind IN ('translated', 'cached', 'flagged', 'failed') AS counts, coalesce(p, 'resumed') = 'resumed' AND seq < coalesce(c, 9e18) AS runs FROM m),
 g AS (SELECT run, max(seq) AS seq, count(*) FILTER (runs AND kind = 'translated') AS translated, count(*) FILTER (runs AND kind = 'cached') AS cached, count(*) FILTER (runs AND kind = 'flagged') AS flagged,
 count(*) FILTER (runs AND kind = 'failed') AS failed, count(*) FILTER (counts AND NOT runs) AS skipped, coalesce(sum(ms) FILTER (counts AND runs), 0) AS ms,
 CASE WHEN any_value(c) IS NOT NULL THEN 'cancelled' WHEN arg_max(p, seq) = 'paused' THEN 'paused' ELSE 'running' END AS phase FROM x GROUP BY run),
 t AS (SELECT run, seq, translated + coalesce(c_nationkey, 0) AS translated, cached, flagged, failed + CASE WHEN c_custkey IS NULL THEN 0 ELSE 1 END AS failed, skipped,
 CAST(ms + coalesce(c_nationkey, 0) * 1000 AS BIGINT) AS elapsed_ms, phase FROM g LEFT JOIN customer ON c_custkey = run)
 SELECT *, translated + cached + flagged + failed AS done, translated + cached + flagged + failed + skipped AS total,
 round(CASE WHEN elapsed_ms > 0 AND translated + cached + flagged + failed > 0 THEN 1000::DOUBLE * (translated + cached + flagged + failed) / elapsed_ms END, 6) AS rate,
 round(CASE WHEN elapsed_ms > 0 AND translated + cached + flagged + failed > 0 THEN skipped / (1000::DOUBLE * (translated + cached + flagged + failed) / elapsed_ms) END, 6) AS eta_s FROM t""")
def live_runs(spark, d):
    totals = live.run_through(live.runs(run_log(log_stream(spark, d)), "run", "event_id", "kind", "ms", run_baseline(spark, d)), "update", "run")
    return live.progress(totals, F.col("skipped"))


# terms, placeholders and addresses made from the tables' own rows; what makes them is SQL that both engines read


def shaped(spark, d, name: str, exprs: dict[str, str]) -> DataFrame:
    return tab(spark, d, name).selectExpr(*(f"{e} AS {n}" for n, e in exprs.items()))


def shape(name: str, exprs: dict[str, str]) -> str:
    return f"(SELECT {', '.join(f'{e} AS {n}' for n, e in exprs.items())} FROM {name})"


def one_of(number: str, *forms: str) -> str:
    """SQL that takes a form by a number's remainder."""
    return f"CASE {number} % {len(forms)} " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(forms)) + " END"


LED = {
    "p_partkey": "p_partkey",
    "term": one_of("p_partkey", "p_name", "'the ' || p_name", "'Der ' || p_name", "'(La) ' || p_name", "'de  ' || p_name", "'The'", "'au ' || p_name", "'of ' || p_name"),
    "lang": one_of("p_size", "'en'", "'es'", "'fr-CA'", "'DE'", "'de_AT'", "'xx'"),
}
_HEAD = "lower(trim(regexp_extract(term, '^(\\S+)\\s', 1), '()'))"


@query(f"""SELECT p_partkey, CASE WHEN list_contains(p.words, {_HEAD}) THEN {_HEAD} END AS particle, CASE WHEN list_contains(p.words, {_HEAD}) THEN trim(regexp_replace(term, '^\\S+\\s+', '')) ELSE term END AS stripped
 FROM {shape('part', LED)} t JOIN {SQL_PARTICLES} ON p.lang = CASE WHEN left(lower(t.lang), 2) IN ('es', 'fr', 'de') THEN left(lower(t.lang), 2) ELSE 'en' END""")
def particle_cases(spark, d):
    return shaped(spark, d, "part", LED).select("p_partkey", T.leading_particle(F.col("term"), F.col("lang")).alias("particle"), T.strip_particle(F.col("term"), F.col("lang")).alias("stripped"))


PAIRED = {"p_partkey": "p_partkey", "s": one_of("p_size", "p_name", "'the ' || p_name", "'of ' || p_name"), "t": one_of("p_partkey", "reverse(p_name)", "'Der ' || reverse(p_name)")}


@query(f"SELECT p_partkey, starts_with(s, 'the ') = starts_with(t, 'Der ') AS is_symmetric FROM {shape('part', PAIRED)}")
def particle_symmetry(spark, d):
    return shaped(spark, d, "part", PAIRED).select("p_partkey", T.symmetric(F.col("s"), F.lit("en"), F.col("t"), F.lit("de")).alias("is_symmetric"))


NAMED = {"p_partkey": "p_partkey", "term": one_of("p_partkey", "p_name", "upper(p_name) || ' Society'", "p_name || ' (' || p_brand || ') Program'", "p_name || ' ('", "'  ' || p_name || ' Company  Limited.'", "p_name || '(x) Council (' || p_type || ' Initiative'", "p_name || ' - !'", "'Society'", "p_name || ' Company Company Company Company Company'")}
_CANON = r"trim(regexp_replace(regexp_replace(trim(regexp_replace(lower(trim(term)), '[.!-]+$', '')), '\s+', ' ', 'g'), '^$', ''))"
for _ in range(4):
    _CANON = rf"trim(regexp_replace(trim(regexp_replace({_CANON}, ' (society|program|company|limited|council|initiative)$', '')), '\s*\([^()]*\)$|\s*\([^()]*$', ''))"
_CANON = f"trim(regexp_replace({_CANON}, '[.!-]+$', ''))"


@query(f"SELECT p_partkey, {_CANON} AS canon FROM {shape('part', NAMED)}")
def canonical_terms(spark, d):
    return shaped(spark, d, "part", NAMED).select("p_partkey", T.canonical(T.nfkc(F.col("term"))).alias("canon"))


@query(f"SELECT o_orderkey, plain AS is_year FROM ({ORACLE_SQL['year_variants']})")
def year_like(spark, d):
    return year_terms(spark, d).select("o_orderkey", T.year_like(F.col("term")).alias("is_year"))


@query(f"SELECT conv_id, turn, source_fault AS why FROM ({ORACLE_SQL['term_caps']})")
def extractor_caps(spark, d):
    return tab(spark, d, "conversations").select("conv_id", "turn", T.cap_violation(F.split_part("text", F.lit(","), F.lit(1))).alias("why"))


PLACED = {"conv_id": "conv_id", "turn": "turn", "t": one_of("(conv_id + turn)", "'[[T0]]' || text || '[[/T0]] [[T1]]'", "'[[T0]]' || text || ' [[T1]]'", "'[[T0]]' || text || '[[/T0]]'", "'[[T0]]' || text || '[[/T0]][[T1]][[T1]]'", "'[[T0]][[/T0]][[T1]]' || text || '[[T7]]'", "' [[T0]] [[/T0]][[T1]] '", "text", "'  '")}


@query(f"SELECT conv_id, turn, trim(regexp_replace(t, '\\[\\[/?T\\d+\\]\\]', '', 'g')) = '' AS empty FROM {shape('conversations', PLACED)}")
def trivially_empty(spark, d):
    return shaped(spark, d, "conversations", PLACED).select("conv_id", "turn", T.trivially_empty(F.col("t")).alias("empty"))


@query(f"""SELECT conv_id, turn, CASE WHEN got LIKE '%T7%' THEN 'unknown:T7' WHEN NOT list_contains(gs, '/T0') THEN 'missing:/T0' WHEN NOT list_contains(gs, 'T0') THEN 'missing:T0' WHEN NOT list_contains(gs, 'T1') THEN 'missing:T1'
 WHEN len(gs) > 3 THEN 'repeated' END AS error FROM (SELECT *, array_to_string(gs, ',') AS got FROM (SELECT *, regexp_extract_all(t, '\\[\\[(/?T\\d+)\\]\\]', 1) AS gs FROM {shape('conversations', PLACED)}))""")
def placeholder_check(spark, d):
    return shaped(spark, d, "conversations", PLACED).select("conv_id", "turn", T.placeholder_error(F.col("t"), F.array(F.lit("pair"), F.lit("void"))).alias("error"))


WAITS = {"event_id": "event_id", "s": one_of("event_id", "user_id || 'ms'", "user_id % 5 || 'h' || event_id % 60 || 'm' || user_id % 60 || 's'", "'' || user_id", "event_id % 60 || 'm' || user_id % 60 || '.5s'", "event_type", "user_id % 9 || 's' || event_id % 1000 || 'ms'", "'-' || user_id")}
_WAIT = one_of("event_id", "user_id", "3600000 * (user_id % 5) + 60000 * (event_id % 60) + 1000 * (user_id % 60)", "1000 * user_id", "60000 * (event_id % 60) + 1000 * (user_id % 60) + 500", "NULL", "1000 * (user_id % 9) + event_id % 1000", "CASE WHEN user_id IS NOT NULL THEN 0 END")


@query(f"SELECT event_id, CAST({_WAIT} AS BIGINT) AS ms FROM events")
def rate_limit_durations(spark, d):
    return shaped(spark, d, "events", WAITS).select("event_id", T.duration_ms(F.col("s")).alias("ms"))


ADDRESSES = {"page_id": "page_id", "u": one_of("page_id", "url", "'http://localhost:' || page_id || '/x'", "'http://192.168.1.' || page_id % 256", "'http://printer' || page_id || '.local/' || url", "'https://172.' || page_id % 40 || '.0.1:99/'", "'http://u@10.0.' || page_id % 256 || '.3'", "'http://127.0.0.1' || '?u=' || url", "'http://[fe80::1]/'", "'10.0.0.1/' || url")}
_SPACE = one_of("page_id", "NULL", "'loopback'", "'local'", "'local'", "CASE WHEN page_id % 40 BETWEEN 16 AND 31 THEN 'local' END", "'local'", "'loopback'", "'local'", "NULL")


@query(f"SELECT page_id, {_SPACE} AS space FROM pages")
def address_space(spark, d):
    return shaped(spark, d, "pages", ADDRESSES).select("page_id", T.address_space(F.col("u")).alias("space"))


LINKS = {"page_id": "page_id", "folder": "split_part(split_part(url, '/', 4), '?', 1)", "suffix": one_of("page_id", "'.PNG'", "'.avif'", "'.css'", "''", "'.jpg#a.gif2'", "'.jpeg?v=1'")}
_MIMES = "CASE suffix WHEN '.PNG' THEN 'image/png' WHEN '.avif' THEN 'image/avif' ELSE 'application/octet-stream' END"


@query(f"SELECT page_id, {_MIMES} AS mime, 'OEBPS/' || folder || '/p' || page_id || split_part(split_part(suffix, '#', 1), '?', 1) AS path FROM {shape('pages', LINKS)}")
def mime_and_path(spark, d):
    href = F.concat(F.lit(".././"), "folder", F.lit("/x/../p"), "page_id", "suffix")
    return shaped(spark, d, "pages", LINKS).select("page_id", T.mime(href).alias("mime"), T.resolve_path(F.lit("OEBPS/text/ch1.xhtml"), href).alias("path"))


# a glossary whose entries are parts, projects are brands and aliases are order lines

BOOK = {
    "id": "'g' || p_partkey", "project_id": "p_brand", "source_term": "CASE WHEN p_size % 5 > 0 THEN p_name || ' ' || p_partkey % 90 END", "target_term": "reverse(p_name) || p_size % 7", "type": "CASE WHEN p_type = 'ECONOMY' THEN 'place' ELSE 'term' END",
    "status": one_of("p_partkey", "'locked'", "'confirmed'", "'proposed'", "'confirmed'"), "source_known": "p_size % 5 > 0", "notes": "CASE WHEN p_size % 11 = 0 THEN 'say \"' || p_name || '\"' END", "gender": "CASE WHEN p_size % 3 = 0 THEN 'm' END", "created_at": "p_partkey",
}
ALIASES = {"entry_id": "'g' || l_partkey", "side": "CASE WHEN l_linenumber % 2 = 0 THEN 'source' ELSE 'target' END", "text": "l_returnflag || '\"' || l_suppkey"}
SQL_BOOK, SQL_ALIASES = shape("part", BOOK), shape("lineitem", ALIASES)
RANK = "CASE status WHEN 'locked' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'proposed' THEN 2 ELSE 99 END"


def book(spark, d):
    return shaped(spark, d, "part", BOOK)


def book_with_aliases(spark, d):
    return glossary.with_aliases(book(spark, d), shaped(spark, d, "lineitem", ALIASES))


@query(f"SELECT id, source_term, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, source_term, id) AS place FROM {SQL_BOOK} WHERE status <> 'proposed' AND source_term IS NOT NULL")
def glossary_constraints(spark, d):
    return glossary.constraints(book(spark, d)).select("id", "source_term", "place")


@query(f"SELECT id, target_term, row_number() OVER (PARTITION BY project_id ORDER BY {RANK}, target_term, id) AS place FROM {SQL_BOOK} WHERE status <> 'proposed' AND source_term IS NULL")
def target_only_terms(spark, d):
    return glossary.target_only(book(spark, d)).select("id", "target_term", "place")


@query(f"""SELECT id, source_term, target_term FROM (SELECT *, CASE WHEN project_id = 'Brand#1' THEN 0 ELSE 1 END AS tier, CASE WHEN project_id = 'Brand#1' THEN 0 ELSE length(project_id) END AS priority FROM {SQL_BOOK}
 WHERE project_id = 'Brand#1' OR status <> 'proposed') QUALIFY row_number() OVER (PARTITION BY CASE WHEN source_term IS NOT NULL THEN type || '::' || lower(source_term) ELSE 'target::' || lower(target_term) END
 ORDER BY tier, priority DESC, coalesce(source_term, target_term), id) = 1""")
def priority_union(spark, d):
    g = book(spark, d)
    return glossary.merged_books(g.where("project_id = 'Brand#1'"), g.where("project_id <> 'Brand#1'").withColumn("priority", F.length("project_id"))).select("id", "source_term", "target_term")


_LISTS = f"""(SELECT entry_id, coalesce(list(text ORDER BY text) FILTER (side = 'source'), []::VARCHAR[]) AS source_aliases, coalesce(list(text ORDER BY text) FILTER (side = 'target'), []::VARCHAR[]) AS target_aliases
 FROM {SQL_ALIASES} GROUP BY entry_id)"""
SQL_ALIASED = f"(SELECT b.*, coalesce(source_aliases, []::VARCHAR[]) AS source_aliases, coalesce(target_aliases, []::VARCHAR[]) AS target_aliases FROM {SQL_BOOK} b LEFT JOIN {_LISTS} ON id = entry_id)"


@query(f"SELECT id, source_aliases, target_aliases FROM {SQL_ALIASED}")
def alias_rollup(spark, d):
    return book_with_aliases(spark, d).select("id", "source_aliases", "target_aliases")


def _json(c: str) -> str:
    return f"""CASE WHEN {c} IS NULL THEN 'null' ELSE '"' || replace({c}, '"', '\\"') || '"' END"""


_FIELDS = {n: f"'[' || array_to_string(list_transform({n}, lambda x: {_json('x')}), ', ') || ']'" if n.endswith("aliases") else "CAST(source_known AS VARCHAR)" if n == "source_known" else _json(n)
           for n in ("gender", "notes", "source_aliases", "source_known", "source_term", "status", "target_aliases", "target_term", "type")}


@query("SELECT project_id, left(sha256('[' || string_agg(item, ', ' ORDER BY coalesce(source_term, ''), target_term, id) || ']'), 32) AS glossary_hash FROM (SELECT *, '{' || "
       + " || ', ' || ".join(f"""'"{n}": ' || {v}""" for n, v in _FIELDS.items()) + f" || '}}' AS item FROM {SQL_ALIASED}) GROUP BY project_id")
def glossary_hash(spark, d):
    return glossary.glossary_hash(book_with_aliases(spark, d))


MERGED = {"winner_id": "'g' || (p_partkey - p_partkey % 10)", "loser_id": "'g' || p_partkey", "same": "p_partkey % 10 = 0"}
_TERMS = f"(SELECT id, source_term AS alias FROM {SQL_BOOK} WHERE source_term IS NOT NULL UNION SELECT entry_id, text FROM {SQL_ALIASES} WHERE side = 'source')"


@query(f"""SELECT DISTINCT winner_id, alias FROM {shape('part', MERGED)} JOIN {_TERMS} x ON x.id = loser_id WHERE NOT same AND winner_id IN (SELECT id FROM {SQL_BOOK})
 AND (winner_id, alias) NOT IN (SELECT id, alias FROM {_TERMS})""")
def merge_entries(spark, d):
    return glossary.merge_entries(book_with_aliases(spark, d), shaped(spark, d, "part", MERGED).where("not same").drop("same"))


@query(f"SELECT id, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(source_term, ''), id) AS place, row_number() OVER (PARTITION BY project_id ORDER BY coalesce(source_term, target_term), id) AS lore_place FROM {SQL_BOOK}")
def glossary_list_order(spark, d):
    g = book(spark, d)
    place = lambda lore: F.row_number().over(W.partitionBy("project_id").orderBy(*reading.listed(g, lore))).cast("bigint")
    return g.select("id", place(False).alias("place"), place(True).alias("lore_place"))


MODELS = {"model": one_of("p_partkey", "'m-'", "'m-'", "'m-'", "'z-'") + " || p_size || " + one_of("p_retailprice", "''", "'-2024-05-01'", "'-mini-x'").replace("p_retailprice", "CAST(floor(p_retailprice) AS BIGINT)")}
PRICED = {"name": "CASE WHEN p_size >= 25 THEN 'm' ELSE 'm-' || p_size END"}


@query(f"""SELECT model, CASE WHEN starts_with(model, 'm-') THEN CASE WHEN CAST(split_part(model, '-', 2) AS INTEGER) < 25 THEN 'm-' || split_part(model, '-', 2) ELSE 'm' END END AS matched
 FROM (SELECT DISTINCT model FROM {shape('part', MODELS)})""")
def price_prefix(spark, d):
    prices = shaped(spark, d, "part", PRICED).distinct().withColumn("prompt_price", F.lit(1.0)).withColumn("completion_price", F.lit(2.0))
    return ledger.priced(shaped(spark, d, "part", MODELS), prices).select("model", "matched")


# merges in full: every part into the first of its ten, with the aliases and mentions of its order lines

NOW = 1_700_000_000_000
SQL_PAIRS = f"(SELECT winner_id, loser_id FROM {shape('part', MERGED)} WHERE NOT same AND winner_id IN (SELECT id FROM {SQL_BOOK}))"
MENTIONS = {"l_orderkey": "l_orderkey", "l_linenumber": "l_linenumber", "entry_id": "'g' || l_partkey"}
REVISIONS = {"id": "'r' || l_orderkey || '-' || l_linenumber", "entry_id": "'g' || l_partkey", "prev_target_term": "l_returnflag", "new_target_term": "l_returnflag || l_linenumber", "reason": "'edit'", "created_at": "l_suppkey"}


def _merged(spark, d) -> dict[str, DataFrame]:
    line = lambda exprs: shaped(spark, d, "lineitem", exprs)
    entries = book(spark, d).withColumn("updated_at", F.col("created_at"))
    return merging.merged(entries, line(ALIASES).withColumn("id", F.lit(None).cast("string")), line(MENTIONS), line(REVISIONS), shaped(spark, d, "part", MERGED).drop("same"), NOW)


@query(f"SELECT id, CASE WHEN id IN (SELECT winner_id FROM {SQL_PAIRS}) THEN {NOW} ELSE created_at END AS updated_at FROM {SQL_BOOK} WHERE id NOT IN (SELECT loser_id FROM {SQL_PAIRS})")
def merged_entries(spark, d):
    return _merged(spark, d)["entries"].select("id", "updated_at")


_WORDS = f"(SELECT id, 'source' AS side, source_term AS text FROM {SQL_BOOK} WHERE source_term <> '' UNION SELECT id, 'target', target_term FROM {SQL_BOOK} WHERE target_term <> '' UNION SELECT entry_id, side, text FROM {SQL_ALIASES})"


@query(f"""SELECT entry_id, side, text FROM {SQL_ALIASES} WHERE entry_id NOT IN (SELECT loser_id FROM {SQL_PAIRS}) UNION ALL
 SELECT * FROM (SELECT winner_id, side, text FROM {SQL_PAIRS} JOIN {_WORDS} ON id = loser_id EXCEPT SELECT id, side, text FROM {_WORDS})""")
def merged_aliases(spark, d):
    return _merged(spark, d)["aliases"].select("entry_id", "side", "text")


@query(f"SELECT l_orderkey, l_linenumber, coalesce(winner_id, entry_id) AS entry_id FROM {shape('lineitem', MENTIONS)} LEFT JOIN {SQL_PAIRS} ON loser_id = entry_id")
def merged_mentions(spark, d):
    return _merged(spark, d)["mentions"]


@query(f"""SELECT entry_id, prev_target_term, new_target_term, reason, created_at FROM {shape('lineitem', REVISIONS)} WHERE entry_id NOT IN (SELECT loser_id FROM {SQL_PAIRS}) UNION ALL
 SELECT id, target_term, target_term, 'merge', {NOW} FROM {SQL_BOOK} WHERE id IN (SELECT winner_id FROM {SQL_PAIRS})""")
def merged_revisions(spark, d):
    return _merged(spark, d)["revisions"].drop("id")


# imports in full: orders come into a glossary of customers

ARRIVED = {
    "seq": "o_orderkey", "source_term": "CASE WHEN o_custkey % 7 > 0 THEN 'term' || o_custkey % 500 END", "type": one_of("o_orderkey", "'term'", "'place'"), "target_term": "o_orderstatus || o_custkey % 11",
    "status": one_of("o_custkey", "'locked'", "'confirmed'", "'proposed'"), "gender": "CASE WHEN o_orderkey % 5 = 0 THEN 'f' END", "notes": "o_orderpriority", "source_known": "o_custkey % 7 > 0",
    "source_aliases": "split('x' || o_custkey % 5 || ',y,' || o_orderstatus, ',')", "target_aliases": "split(o_orderpriority, '-')",
}
HELD = {
    "id": "'c' || c_custkey", "project_id": "CASE WHEN c_custkey % 6 > 0 THEN 'p' ELSE 'q' END", "source_term": "'term' || c_custkey % 300", "type": one_of("c_custkey", "'term'", "'place'"), "target_term": "c_mktsegment",
    "status": "'confirmed'", "gender": "CASE WHEN c_custkey % 5 = 0 THEN 'f' END", "notes": "c_name", "source_known": "true", "created_at": "c_custkey", "updated_at": "c_custkey",
}
HELD_ALIASES = {"id": "'a' || c_custkey", "entry_id": "'c' || c_custkey", "side": one_of("c_custkey", "'source'", "'target'", "'source'"), "text": "c_mktsegment"}
SQL_STEPS = f"""WITH k AS (SELECT source_term AS s, type AS t, min(id) AS kid, arg_min(target_term, id) AS kt, arg_min(status, id) AS ks FROM {shape('customer', HELD)} WHERE project_id = 'p' GROUP BY ALL),
 r AS (SELECT i.*, kid, coalesce(lag(target_term) OVER w, kt) AS pt, coalesce(lag(status) OVER w, ks) AS ps, coalesce(kid, left(sha256('p' || chr(1) || 'import' || chr(1) || first_value(seq) OVER w), 32)) AS entry_id, row_number() OVER w AS n,
 coalesce(kt, first_value(target_term) OVER w) AS ft, first_value(source_aliases) OVER w AS fs FROM {shape('orders', ARRIVED)} i LEFT JOIN k ON source_term = s AND type = t
 WINDOW w AS (PARTITION BY source_term, type, CASE WHEN source_term IS NULL THEN seq END ORDER BY seq))"""


def _imported(spark, d, policy: str) -> dict[str, DataFrame]:
    held = shaped(spark, d, "customer", HELD_ALIASES), spark.createDataFrame([], lorebook.SCHEMAS["revisions"])
    return imports.imported(shaped(spark, d, "customer", HELD).withColumn("updated_at", F.col("updated_at").cast("bigint")), *held, shaped(spark, d, "orders", ARRIVED), "p", policy, NOW)


@query(f"{SQL_STEPS} SELECT seq, entry_id, CASE WHEN kid IS NULL AND n = 1 THEN 'created' ELSE 'updated' END AS outcome FROM r")
def import_outcomes(spark, d):
    return _imported(spark, d, "overwrite")["outcomes"]


@query(f"""{SQL_STEPS}, l AS (SELECT entry_id, arg_max(target_term, seq) AS lt, arg_max(notes, seq) AS ln FROM r GROUP BY entry_id)
 SELECT id, project_id, coalesce(lt, target_term) AS target_term, coalesce(ln, notes) AS notes, CAST(CASE WHEN lt IS NOT NULL THEN {NOW} ELSE updated_at END AS BIGINT) AS updated_at FROM {shape('customer', HELD)} LEFT JOIN l ON id = entry_id
 UNION ALL SELECT entry_id, 'p', lt, ln, {NOW} FROM l WHERE entry_id NOT IN (SELECT id FROM {shape('customer', HELD)})""")
def import_entries(spark, d):
    return _imported(spark, d, "overwrite")["entries"].select("id", "project_id", "target_term", "notes", "updated_at")


@query(f"{SQL_STEPS} SELECT entry_id, pt AS prev_target_term, target_term AS new_target_term, 'import_json:overwrite' AS reason FROM r WHERE (kid IS NOT NULL OR n > 1) AND (target_term <> pt OR status <> ps)")
def import_revisions(spark, d):
    return _imported(spark, d, "overwrite")["revisions"].select("entry_id", "prev_target_term", "new_target_term", "reason")


@query(f"""{SQL_STEPS}, l AS (SELECT entry_id, arg_max(source_aliases, seq) AS sa, arg_max(target_aliases, seq) AS ta FROM r GROUP BY entry_id)
 SELECT DISTINCT entry_id, side, text FROM (SELECT entry_id, 'source' AS side, unnest(sa) AS text FROM l UNION ALL SELECT entry_id, 'target', unnest(ta) FROM l) WHERE text <> ''
 UNION ALL SELECT entry_id, side, text FROM {shape('customer', HELD_ALIASES)} WHERE entry_id NOT IN (SELECT entry_id FROM l)""")
def import_aliases(spark, d):
    return _imported(spark, d, "overwrite")["aliases"].select("entry_id", "side", "text")


@query(f"""{SQL_STEPS} SELECT seq, r.entry_id AS existing_id, ft AS existing_target, target_term AS incoming_target, CASE WHEN kid IS NULL THEN array_to_string(list_sort(list_distinct(fs)), ',') ELSE CASE WHEN a.side = 'source' THEN a.text ELSE '' END END AS existing_aliases,
 source_aliases[1] || ',' || source_aliases[2] || ',' || source_aliases[3] AS incoming_aliases FROM r LEFT JOIN {shape('customer', HELD_ALIASES)} a ON a.entry_id = kid WHERE kid IS NOT NULL OR n > 1""")
def import_conflicts(spark, d):
    c = _imported(spark, d, "collect")["conflicts"]
    return c.select("seq", "existing_id", F.col("existing.target_term").alias("existing_target"), F.col("incoming.target_term").alias("incoming_target"), F.array_join("existing.source_aliases", ",").alias("existing_aliases"), F.array_join("incoming.source_aliases", ",").alias("incoming_aliases"))


# a lore book as a bundle: the parts of one brand, written and read again under a new id

BRAND, FRESH = "Brand#1", "lore-2"
SQL_SOLD = f"(SELECT DISTINCT 'a' || l_partkey || '-' || l_suppkey || '-' || l_linenumber AS id, 'g' || l_partkey AS entry_id, CASE WHEN l_linenumber % 2 = 0 THEN 'source' ELSE 'target' END AS side, l_returnflag AS text FROM lineitem)"


def _bundle(spark, d) -> dict[str, DataFrame]:
    meta = tab(spark, d, "part").select(F.col("p_brand").alias("id")).distinct().select("id", F.concat(F.lit("Book of "), "id").alias("name"), F.lit("en").alias("source_lang"), F.lit("de").alias("target_lang"), F.lit(None).cast("string").alias("description"), F.lit("term").alias("default_proposal_kind"), F.lit(1).cast("bigint").alias("created_at"))
    sold = tab(spark, d, "lineitem").select(F.concat(F.lit("a"), F.concat_ws("-", "l_partkey", "l_suppkey", "l_linenumber")).alias("id"), F.concat(F.lit("g"), "l_partkey").alias("entry_id"), F.when(F.col("l_linenumber") % 2 == 0, "source").otherwise("target").alias("side"), F.col("l_returnflag").alias("text"))
    revisions = shaped(spark, d, "lineitem", REVISIONS)
    sources = tab(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("Brand#"), F.col("s_suppkey") % 5).alias("project_id"), F.lit("epub").alias("kind"), F.col("s_name").alias("title"), F.lit("").alias("path"), F.col("s_suppkey").alias("ingested_at"))
    path = f"{shared_dir(spark)}/folioscope/lore-{uuid.uuid4().hex}"
    lorebook.export_lore(BRAND, meta, {"entries": book(spark, d), "aliases": sold.distinct(), "revisions": revisions, "sources": sources}, path, NOW)
    return lorebook.import_lore(spark, path, FRESH, NOW)


_NEW = f"left(sha256('{FRESH}' || chr(1) || {{}}), 32)"


@query(f"SELECT {_NEW.format('id')} AS id, '{FRESH}' AS project_id, source_term, target_term, status, source_known FROM {SQL_BOOK} WHERE project_id = '{BRAND}'")
def lore_bundle_entries(spark, d):
    return _bundle(spark, d)["entries"].select("id", "project_id", "source_term", "target_term", "status", "source_known")


@query(f"SELECT {_NEW.format('id')} AS id, {_NEW.format('entry_id')} AS entry_id, side, text FROM {SQL_SOLD} WHERE entry_id IN (SELECT id FROM {SQL_BOOK} WHERE project_id = '{BRAND}')")
def lore_bundle_aliases(spark, d):
    return _bundle(spark, d)["aliases"]


@query(f"""SELECT 'lore.imported' AS kind, '{FRESH}' AS project_id, '{{"source_id":"{BRAND}","entries":' || (SELECT count(*) FROM {SQL_BOOK} WHERE project_id = '{BRAND}') || ',"aliases":' ||
 (SELECT count(*) FROM {SQL_SOLD} WHERE entry_id IN (SELECT id FROM {SQL_BOOK} WHERE project_id = '{BRAND}')) || ',"schema_version":1}}' AS payload_json""")
def lore_bundle_event(spark, d):
    return _bundle(spark, d)["events"].select("kind", "project_id", "payload_json")


# previews and replays

SQL_ASKED = """(WITH c AS (SELECT a.conv_id, a.turn, b.turn AS bt, trim(b.text) AS t, row_number() OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS k, sum(length(trim(b.text))) OVER (PARTITION BY a.conv_id, a.turn ORDER BY b.turn DESC) AS run
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn AND b.turn >= a.turn - 12 WHERE trim(b.text) <> ''),
 g AS (SELECT conv_id, turn, string_agg(t, chr(10) ORDER BY bt) AS before, count(*) AS n FROM c WHERE k <= 3 AND (k = 1 OR run <= 400) GROUP BY ALL)
 SELECT conv_id || '-' || turn AS id, role, coalesce(before, '') || chr(10) || chr(10) || text AS user_text, CAST(coalesce(n, 0) AS INTEGER) AS n_context FROM conversations LEFT JOIN g USING (conv_id, turn) WHERE trim(text) <> '')"""
SQL_KEYED = f"(SELECT *, sha256('mock:' || sha256('translate') || ':' || sha256('user' || chr(0) || user_text) || ':' || repeat('0', 32)) AS cache_key FROM {SQL_ASKED})"


@query(f"""SELECT k.id, n_context, CAST(2 + greatest(1, floor(length(user_text) / 4)) AS BIGINT) AS prompt_tokens, cache_key, sha256(user_text) AS user_sha256, h.hit_id FROM {SQL_KEYED} k LEFT JOIN
 (SELECT cache_key, min(id) AS hit_id FROM {SQL_KEYED} WHERE role = 'assistant' GROUP BY cache_key) h USING (cache_key)""")
def segment_previews(spark, d):
    c = tab(spark, d, "conversations")
    s = c.select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), F.col("text").alias("source_text"), "role")
    calls = batch.asked(s, "0" * 32, "mock").where("role = 'assistant'").select(F.col("id").alias("call_id"), "cache_key", F.lit(True).alias("ok"), F.lit(0).alias("created_at"))
    return replays.preview(s, calls, "0" * 32).select("id", "n_context", "prompt_tokens", "cache_key", F.sha2("user_text", 256).alias("user_sha256"), "hit_id")


SQL_HITS = f"(SELECT s.*, k.c FROM {SEGMENTS} s JOIN (SELECT source_text AS k, min(doc_id) AS c FROM {SEGMENTS} WHERE status <> 'pending' GROUP BY source_text) k ON s.source_text = k.k)"
SQL_FOUND = f"(SELECT doc_id, count(*) AS n, bool_or(severity = 'error' OR entry_id IS NULL) AS bad FROM ({ORACLE_SQL['all_violations']}) GROUP BY doc_id)"


def _replayed(spark, d) -> dict[str, DataFrame]:
    """Documents asked again where a labelled document had the same text; a third of the replies are plain content, a few of no use."""
    s = segments(spark, d).withColumn("cache_key", F.sha2("source_text", 256))
    k = F.col("doc_id") % 9
    content = F.to_json(F.struct(F.to_json(F.struct(F.col("target_text").alias("target"))).alias("content")))
    response = F.when(k < 5, F.to_json(F.struct(F.struct(F.col("target_text").alias("target")).alias("trace")))).when(k < 8, content).otherwise(F.lit("{}"))
    calls = s.where("status <> 'pending'").select(F.col("doc_id").alias("call_id"), "cache_key", F.lit(True).alias("ok"), F.lit(0).alias("created_at"), F.lit("m").alias("model"), F.lit(1).alias("prompt_tokens"), F.lit(2).alias("completion_tokens"), response.alias("response"))
    g = values(spark, GLOSSARY).withColumn("target_aliases", F.array().cast("array<string>"))
    asked = s.select(F.col("doc_id").alias("id"), "source_text", "cache_key", F.array().cast("array<string>").alias("kinds"))
    return replays.replayed(asked, calls, g, "de", NOW)


@query(f"""SELECT h.doc_id AS id, CASE WHEN c % 9 < 8 THEN sha256(target_text) END AS target_sha256, CASE WHEN c % 9 = 8 THEN 'failed' WHEN bad THEN 'flagged' ELSE 'translated' END AS status, CAST(CASE WHEN c % 9 < 8 THEN coalesce(n, 0) ELSE 0 END AS BIGINT) AS n_violations,
 CASE WHEN c % 9 = 8 THEN 'cached call has no usable reply' END AS error FROM {SQL_HITS} h LEFT JOIN {SQL_FOUND} v ON v.doc_id = h.doc_id""")
def replayed_segments(spark, d):
    return _replayed(spark, d)["segments"].select("id", F.sha2("target_text", 256).alias("target_sha256"), "status", "n_violations", "error")


@query(f"SELECT h.doc_id AS segment_id, unnest(CASE WHEN n > 0 THEN ['segment.translated', 'segment.flagged'] ELSE ['segment.translated'] END) AS kind, coalesce(n, 0) AS violations FROM {SQL_HITS} h LEFT JOIN {SQL_FOUND} v ON v.doc_id = h.doc_id WHERE c % 9 < 8")
def replay_events(spark, d):
    return _replayed(spark, d)["events"].select("segment_id", "kind", F.get_json_object("payload_json", "$.violations").cast("bigint").alias("violations"))


# orders of glossary tables and of what belongs to their entries

_HEADS = {"status": f"CASE status WHEN 'proposed' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'locked' THEN 2 ELSE 99 END", "type": "type", "source": "lower(coalesce(source_term, ''))", "target": "lower(target_term)", "uses": "coalesce(uses, 0)", "updated": "created_at"}  # noqa: F541
_PLACES = ", ".join(f"row_number() OVER (PARTITION BY project_id ORDER BY {e}{' DESC' if h in ('uses', 'updated') else ''}, id) AS by_{h}" for h, e in _HEADS.items())


@query(f"SELECT id, {_PLACES} FROM {SQL_BOOK} LEFT JOIN (SELECT entry_id, count(*) AS uses FROM {shape('lineitem', MENTIONS)} GROUP BY entry_id) ON id = entry_id")
def glossary_sorted(spark, d):
    uses = shaped(spark, d, "lineitem", MENTIONS).groupBy("entry_id").agg(F.count(F.lit(1)).alias("uses"))
    g = book(spark, d).withColumn("updated_at", F.col("created_at")).join(uses, F.col("id") == F.col("entry_id"), "left")
    place = lambda h: F.row_number().over(W.partitionBy("project_id").orderBy(*reading.sorted_by(h, h in ("uses", "updated")))).cast("bigint").alias(f"by_{h}")
    return g.select("id", *map(place, _HEADS))


@query(f"SELECT entry_id, id, row_number() OVER (PARTITION BY entry_id ORDER BY created_at, id) AS place FROM {shape('lineitem', REVISIONS)}")
def revision_order(spark, d):
    return shaped(spark, d, "lineitem", REVISIONS).select("entry_id", "id", F.row_number().over(W.partitionBy("entry_id").orderBy(*reading.history("revisions"))).cast("bigint").alias("place"))


# lore books attached to projects, by a log of commands


@query("""WITH a AS (SELECT o_custkey % 40 AS p, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 60 END AS e, CAST(count(*) FILTER (o_orderkey % 5 <> 0) OVER (PARTITION BY o_custkey % 40 ORDER BY o_orderkey) AS BIGINT) AS c FROM orders)
 SELECT 'p' || p AS project_id, 'l' || seq AS lore_id, CAST(coalesce(e, c + max(coalesce(e - c, -1)) OVER (PARTITION BY p ORDER BY seq)) AS BIGINT) AS priority, seq AS attached_at FROM a""")
def lore_attached(spark, d):
    o = tab(spark, d, "orders").select(F.concat(F.lit("p"), F.col("o_custkey") % 40).alias("project_id"), F.col("o_orderkey").alias("seq"), F.lit("attach").alias("verb"), F.concat(F.lit("l"), "o_orderkey").alias("lore_id"), F.lit(None).cast("string").alias("mode"), F.when(F.col("o_orderkey") % 5 == 0, F.col("o_custkey") % 60).alias("priority"))
    return attachments.attached_after(attachments.facts(o)).select("project_id", "lore_id", "priority", "attached_at")


@query("""WITH e AS (SELECT 'p' || user_id % 20 AS project_id, event_id AS seq, 'l' || user_id AS lore_id, event_type AS t FROM events WHERE event_type <> 'view'),
 s AS (SELECT *, max(CASE WHEN t IN ('signup', 'click') THEN seq END) OVER w AS a, max(CASE WHEN t = 'error' THEN seq END) OVER w AS x FROM e WINDOW w AS (PARTITION BY project_id, lore_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 f AS (SELECT *, coalesce(a > coalesce(x, -1), false) AS there FROM s)
 SELECT project_id, seq, lore_id, CASE t WHEN 'error' THEN 'lore.detached' WHEN 'purchase' THEN 'lore.mode_changed' ELSE 'lore.attached' END AS kind, CASE WHEN t IN ('signup', 'click') THEN there END AS updated FROM f WHERE there OR t IN ('signup', 'click')""")
def lore_events(spark, d):
    e = tab(spark, d, "events").where("event_type <> 'view'")
    verb = F.when(F.col("event_type") == "error", "detach").when(F.col("event_type") == "purchase", "mode").otherwise("attach")
    c = e.select(F.concat(F.lit("p"), F.col("user_id") % 20).alias("project_id"), F.col("event_id").alias("seq"), verb.alias("verb"), F.concat(F.lit("l"), "user_id").alias("lore_id"), F.lit("propose").alias("mode"), F.lit(None).cast("bigint").alias("priority"))
    return attachments.facts(c).select("project_id", "seq", "lore_id", "kind", "updated")


# replies, options and languages


REPLIES = {"conv_id": "conv_id", "turn": "turn", "reply": one_of("(conv_id + turn)", *("'" + x + "'" for x in ('{"target": "\' || role || turn || \'", "notes": null}', 'Here: {"target": "\' || role || \'"} done', "no reply \' || role || \'", '{"text": "\' || role || \'"}', '{"target": \' || turn || \'}', "{")))}
_REPLY = one_of("(conv_id + turn)", "role || turn", "role", "NULL", "NULL", "CAST(turn AS VARCHAR)", "NULL")
_FAULT = one_of("(conv_id + turn)", "NULL", "NULL", "'no JSON'", "'no target'", "NULL", "'no target'")


@query(f"SELECT conv_id, turn, {_REPLY} IS NOT NULL AS ok, {_REPLY} AS target, {_FAULT} AS error FROM conversations")
def parsed_replies(spark, d):
    r = shaped(spark, d, "conversations", REPLIES).withColumn("p", prompts.parsed(F.col("reply"), "target string, notes string", "target"))
    return r.select("conv_id", "turn", "p.ok", "p.value.target", "p.error")


CLAIMED = {"p_partkey": "p_partkey", "term": "' ' || p_name || ' '", "kind": one_of("p_partkey", "'place'", "'planet'", "NULL", "'date_or_time'"), "confidence": "p_size / 25.0 - 0.5"}


@query(f"SELECT p_partkey, trim(term) AS term, CASE WHEN kind IN ('place', 'date_or_time') THEN kind ELSE 'term' END AS type, round(greatest(0, least(1, CAST(confidence AS DOUBLE))), 9) AS confidence FROM {shape('part', CLAIMED)}")
def claimed_entities(spark, d):
    c = shaped(spark, d, "part", CLAIMED).withColumn("e", prompts.entity(F.col("term"), F.col("kind"), F.col("confidence")))
    return c.select("p_partkey", "e.term", "e.type", F.round("e.confidence", 9).alias("confidence"))


TAGS = {"doc_id": "doc_id", "tag": one_of("doc_id", "lang", "upper(lang)", "lang || '-XX'", "'zz-' || lang", "'DE-at'")}


@query(f"""WITH n AS (SELECT lang, 'lang ' || lang || ' of ' || count(*) AS name FROM documents GROUP BY lang UNION ALL SELECT 'de-AT', 'Austrian') SELECT doc_id, tag, coalesce(a.name, b.name) AS name
 FROM {shape('documents', TAGS)} t LEFT JOIN n a ON lower(a.lang) = lower(t.tag) LEFT JOIN n b ON lower(b.lang) = lower(split_part(t.tag, '-', 1))""")
def language_names(spark, d):
    counted = tab(spark, d, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    names = counted.select("lang", F.concat(F.lit("lang "), "lang", F.lit(" of "), "n").alias("name")).unionByName(spark.sql("SELECT 'de-AT' AS lang, 'Austrian' AS name"))
    return prompts.by_tag(shaped(spark, d, "documents", TAGS), "tag", names, "lang", "name").select("doc_id", "tag", "name")


@query("""SELECT p_partkey, rank FROM (SELECT *, CASE WHEN lower(p_brand) = 're' OR lower(p_name) = 're' THEN 1 WHEN starts_with(lower(p_brand), 're') OR starts_with(lower(p_name), 're') THEN 2 WHEN contains(lower(p_brand), 're') OR contains(lower(p_name), 're') THEN 3 END AS rank FROM part)
 WHERE rank IS NOT NULL ORDER BY rank, p_partkey LIMIT 12""")
def language_search(spark, d):
    return prompts.search(tab(spark, d, "part"), " Re ", "p_brand", "p_name", "p_partkey").select("p_partkey", "rank")


VOICES = {"doc_id": "doc_id", "register": one_of("doc_id", "' Plain-Spoken '", "'literary'", "NULL", "'plain  spoken'", "source"), "audience": one_of("doc_id % 7", "'Young Readers'", "NULL", "'adults'", "'young_readers'", "lang", "''", "'x'")}
_VOICE = "CASE WHEN doc_id % 5 IN (0, 3) THEN 'plain' WHEN doc_id % 7 IN (0, 3) THEN 'young' WHEN doc_id % 5 = 1 THEN 'fine' END"


@query(f"SELECT doc_id, {_VOICE} AS profile, CASE WHEN doc_id % 4 = 0 THEN 'own ' || lang ELSE {_VOICE} || ' text' END AS guide, doc_id % 4 <> 0 AS may_apply FROM documents")
def style_choices(spark, d):
    rules = [("register", "plain_spoken", "plain"), ("audience", "young_readers", "young"), ("register", "literary", "fine")]
    v = shaped(spark, d, "documents", VOICES | {"own": "CASE doc_id % 4 WHEN 0 THEN 'own ' || lang WHEN 1 THEN '  ' END"}).withColumn("profile", prompts.style(F.col("register"), F.col("audience"), rules))
    guide = prompts.style_guide(F.col("own"), F.concat("profile", F.lit(" text")))
    return v.select("doc_id", "profile", guide.alias("guide"), prompts.may_apply(F.when(F.col("doc_id") % 4 == 0, F.col("own")).when(F.col("doc_id") % 4 == 1, F.lit("t")), F.lit("t")).alias("may_apply"))


OPTIONS = {"o_orderkey": "o_orderkey", "c": one_of("o_orderkey", "'' || o_custkey % 50", "'abc'", "'-' || o_custkey", "NULL", "o_custkey % 9 || '.5'", "'NaN'")}


@query(f"SELECT o_orderkey, CASE WHEN TRY_CAST(c AS DOUBLE) IS NULL OR c = 'NaN' THEN 12.0::DOUBLE ELSE greatest(1.0::DOUBLE, least(32.0::DOUBLE, CAST(c AS DOUBLE))) END AS option FROM {shape('orders', OPTIONS)}")
def number_options(spark, d):
    return shaped(spark, d, "orders", OPTIONS).select("o_orderkey", prompts.clamped(F.col("c"), 12, 1, 32).alias("option"))


STORED = {"page_id": "page_id", "c": one_of("page_id", *("'" + x + "'" for x in ('{"skeleton":[{"tag":"em","kind":"pair","attrs":{"id":"\' || page_id || \'"}}],"host_path":"/p[\' || page_id || \']","host_part":\' || page_id % 3 || \',"host_total_parts":3}', ' [{"tag":"br","kind":"void","attrs":{}},{"tag":"i","kind":"pair","attrs":{}}]', '{"host_path":"/x"}', "oops")))}


@query(f"""SELECT page_id, CAST({one_of('page_id', '1', '2', '0', '0')} AS INTEGER) AS n, {one_of('page_id', "'em'", "'br'", 'NULL', 'NULL')} AS tag, {one_of('page_id', "'/p[' || page_id || ']'", "''", "'/x'", "''")} AS host_path,
 CAST(CASE WHEN page_id % 4 = 0 THEN page_id % 3 ELSE 0 END AS INTEGER) AS part, CAST(CASE WHEN page_id % 4 = 0 THEN 3 ELSE 1 END AS INTEGER) AS parts FROM pages""")
def stored_skeletons(spark, d):
    s = shaped(spark, d, "pages", STORED).withColumn("s", prompts.skeleton(F.col("c")))
    return s.select("page_id", F.size("s.skeleton").alias("n"), F.try_element_at("s.skeleton", F.lit(1))["tag"].alias("tag"), "s.host_path", F.col("s.host_part").alias("part"), F.col("s.host_total_parts").alias("parts"))


PADDED = {"conv_id": "conv_id", "turn": "turn", "s": one_of("turn", "' ' || text || '  '", "text", "'   ' || text", "'  '"), "t": one_of("conv_id", "reverse(text)", "'  ' || reverse(text)", "reverse(text) || ' '")}
_LEAD, _TRAIL = one_of("turn", "' '", "''", "'   '", "'  '"), one_of("turn", "'  '", "''", "''", "''")


@query(f"SELECT conv_id, turn, sha256(CASE WHEN conv_id % 3 = 1 THEN t ELSE {_LEAD} || t END || CASE WHEN conv_id % 3 = 2 THEN '' ELSE {_TRAIL} END) AS sha FROM {shape('conversations', PADDED)}")
def outer_white_space(spark, d):
    return shaped(spark, d, "conversations", PADDED).select("conv_id", "turn", F.sha2(T.outer_space(F.col("s"), F.col("t")), 256).alias("sha"))


_SHORT = "(n + {u} // 20) // {u} || '.' || ((n + {u} // 20) // ({u} // 10)) % 10"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN n >= 1000000000 THEN {_SHORT.format(u=10**9)} || 'B' WHEN n >= 1000000 THEN {_SHORT.format(u=10**6)} || 'M' WHEN n >= 1000 THEN {_SHORT.format(u=1000)} || 'K' ELSE CAST(n AS VARCHAR) END AS short
 FROM (SELECT *, l_orderkey * CAST(power(7, l_linenumber) AS BIGINT) AS n FROM lineitem)""")
def compact_numbers(spark, d):
    n = F.col("l_orderkey") * F.pow(F.lit(7), F.col("l_linenumber")).cast("bigint")
    return tab(spark, d, "lineitem").select("l_orderkey", "l_linenumber", T.compact_number(n).alias("short"))


# images, hints, dialogue


@query("""WITH h AS (SELECT l_orderkey, l_suppkey % 3 AS host, min(l_linenumber) AS idx FROM lineitem GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY idx) - 1 AS k FROM h)
 SELECT o_orderkey AS chapter, 'i' || o_orderkey AS src, CAST(coalesce(idx, 2147483647) AS INTEGER) AS before_idx FROM orders LEFT JOIN n ON l_orderkey = o_orderkey AND k = o_custkey % 4""")
def image_places(spark, d):
    hosts = tab(spark, d, "lineitem").select(F.col("l_orderkey").alias("chapter"), (F.col("l_suppkey") % 3).alias("host_path"), F.col("l_linenumber").alias("idx"))
    images = tab(spark, d, "orders").select(F.col("o_orderkey").alias("chapter"), F.concat(F.lit("i"), "o_orderkey").alias("src"), (F.col("o_custkey") % 4).alias("splice_at"))
    return retrieval.image_places(hosts, images)


INLINE = {"page_id": "page_id", "src": one_of("page_id", "'../img/p%20' || page_id || '.PNG?x=1'", "'/top/' || page_id || '.gif'", "'data:image/png;base64,x'", "'http://x/' || page_id || '.png'", "'a+b' || page_id || '.svg#f'", "'bad%ff' || page_id || '.jpg'", "NULL", "'#f'"), "name": one_of("page_id % 3", "'src'", "'href'", "'xlink:href'")}
_PATH = one_of("page_id", "'OEBPS/img/p ' || page_id || '.PNG'", "'top/' || page_id || '.gif'", "NULL", "NULL", "'OEBPS/text/a+b' || page_id || '.svg'", "'OEBPS/text/bad%ff' || page_id || '.jpg'", "NULL", "NULL")
_KIND = one_of("page_id", "'image/png'", "'image/gif'", "NULL", "NULL", "'image/svg+xml'", "'image/jpeg'", "NULL", "NULL")


@query(f"SELECT page_id AS id, 1 AS token, {_PATH} AS path, {_KIND} AS mime, page_id % 16 < 8 AS found FROM pages WHERE {_PATH} IS NOT NULL")
def inline_images(spark, d):
    p = shaped(spark, d, "pages", INLINE).withColumn("chapter_href", F.lit("OEBPS/text/ch.xhtml"))
    token = lambda tag, kind, attrs: F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("kind"), attrs.alias("attrs"))
    s = p.select(F.col("page_id").alias("id"), "chapter_href", F.array(token("em", "pair", F.create_map(F.lit("src"), F.lit("x.png"))), token("IMG", "void", F.create_map("name", "src"))).alias("skeleton"))
    assets = retrieval.inline_images(s, s.select(F.lit("").alias("path"))).where("id % 16 < 8").select("path")
    return retrieval.inline_images(s, assets)


@query(f"""WITH j AS (SELECT q.vec_id AS s, e.vec_id AS e, 't' || e.vec_id % 50 AS term, round({COS.format(a='q.embedding', b='e.embedding')}, 12) AS sim FROM embeddings q, embeddings e WHERE q.vec_id % 20 = 0 AND e.vec_id % 3 = 1),
 k AS (SELECT * FROM j WHERE sim >= 0.2 QUALIFY row_number() OVER (PARTITION BY s ORDER BY sim DESC, 'e:' || e) <= 8) SELECT CAST(s AS VARCHAR) AS segment_id, string_agg(CAST(e AS VARCHAR), ',' ORDER BY term, CAST(e AS VARCHAR)) AS hints FROM k GROUP BY s""")
def proposed_hints(spark, d):
    e = tab(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    h = retrieval.hints(e.where("id % 20 = 0"), e.where("id % 3 = 1").withColumn("source_term", F.concat(F.lit("t"), F.col("id") % 50)), 8, 0.2)
    return h.select("segment_id", F.array_join("hints", ",").alias("hints"))


@query(f"""WITH x AS (SELECT c.*, is_dialogue AS d FROM (SELECT doc_id, source AS chapter, trim(text) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS idx FROM documents) c JOIN ({ORACLE_SQL['dialogue_flag']}) USING (doc_id)),
 p AS (SELECT a.doc_id, b.doc_id AS ref, row_number() OVER w AS k, sum(length(b.t)) OVER w AS run FROM x a JOIN x b ON a.chapter = b.chapter AND b.idx < a.idx AND b.idx >= a.idx - 48 AND a.d AND b.d AND b.t <> '' WINDOW w AS (PARTITION BY a.doc_id ORDER BY b.idx DESC))
 SELECT x.doc_id, CAST(count(k) AS INTEGER) AS n_context FROM x LEFT JOIN p ON p.doc_id = x.doc_id AND k <= 3 AND (k = 1 OR run <= 4000) GROUP BY x.doc_id""")
def dialogue_context(spark, d):
    s = chapters(tab(spark, d, "documents")).withColumn("d", T.dialogue(F.col("text")))
    c = context.previous(s, "chapter", "idx", "text", most=3, budget=4000, reach=16, only=F.col("d"))
    return c.select("doc_id", F.when(F.col("d"), F.size("context")).otherwise(0).alias("n_context"))


# round trips through files


def _folder(spark) -> str:
    return f"{shared_dir(spark)}/folioscope/exchange-{uuid.uuid4().hex}"


SQL_LISTED = "array_to_string(source_aliases, '|') AS source_aliases, array_to_string(target_aliases, '|') AS target_aliases"


@query(f"SELECT source_term, target_term, type, status, source_known, notes, gender, {SQL_LISTED} FROM {SQL_ALIASED}")
def csv_round_trip(spark, d):
    path = _folder(spark)
    exchange.write_csv(book_with_aliases(spark, d), path)
    flat = lambda c: F.array_join(c, "|").alias(c)
    return exchange.read_csv(spark, path).select("source_term", "target_term", "type", "status", "source_known", "notes", "gender", flat("source_aliases"), flat("target_aliases"))


@query(f"SELECT source_term, target_term, type, status, source_known, notes, gender, {SQL_LISTED} FROM {SQL_ALIASED}")
def json_round_trip(spark, d):
    path = _folder(spark)
    exchange.write_json(book_with_aliases(spark, d), path)
    flat = lambda c: F.array_join(c, "|").alias(c)
    return exchange.read_json(spark, path).select("source_term", "target_term", "type", "status", "source_known", "notes", "gender", flat("source_aliases"), flat("target_aliases"))


@query("SELECT vec_id, 'new' AS project_id, CAST(len(embedding) AS INTEGER) AS dim, embedding[1] AS head, embedding[-1] AS tail FROM embeddings")
def bundle_round_trip(spark, d):
    path, v = _folder(spark), tab(spark, d, "embeddings").select("vec_id", F.lit("old").alias("project_id"), F.col("embedding").alias("vector"))
    exchange.export_bundle({"embeddings": v}, path, "old")
    got = exchange.import_bundle(spark, path, {"embeddings": "vec_id bigint, project_id string, vector array<float>"}, "new")["embeddings"]
    return got.select("vec_id", "project_id", F.size("vector").alias("dim"), F.element_at("vector", 1).alias("head"), F.element_at("vector", -1).alias("tail"))


# the batch run over conversations, a chapter each


_SPOKEN = "(SELECT conv_id, turn, conv_id || '-' || turn AS id, text AS source_text, '[mock-tr] ' || text AS target_text FROM conversations WHERE trim(text) <> '')"
_WORD_PAIRS = f"(SELECT id, ws, unnest(range(1, len(ws))) AS i FROM (SELECT id, list_transform(regexp_extract_all(target_text, '\\p{{L}}+(?:''\\p{{L}}+)?'), lambda x: lower(x)) AS ws FROM {_SPOKEN}))"
_DOUBLED = f"(SELECT id FROM {_WORD_PAIRS} WHERE ws[i] = ws[i + 1] AND list_contains((SELECT words FROM {SQL_PARTICLES} WHERE p.lang = 'en'), ws[i]))"


@query(f"""WITH v AS (SELECT s.id, g.status = 'locked' AND g.source_known AS bad FROM {_SPOKEN} s, {duck(GLOSSARY)} WHERE g.status <> 'proposed' AND g.source_term IS NOT NULL AND {_hits('g.source_term', 's.source_text')} > 0 AND {_hits('g.target_term', 's.target_text')} = 0
 UNION ALL SELECT id, true FROM {_DOUBLED}), n AS (SELECT id, count(*) AS n, bool_or(bad) AS bad FROM v GROUP BY id)
 SELECT s.id, cache_key, sha256(s.target_text) AS target_sha256, CAST(coalesce(n.n, 0) AS BIGINT) AS n_violations, CASE WHEN bad THEN 'flagged' ELSE 'translated' END AS status FROM {_SPOKEN} s JOIN {SQL_KEYED} k USING (id) LEFT JOIN n USING (id)""")
def run_statuses(spark, d):
    s = tab(spark, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("id"), F.col("conv_id").alias("chapter"), F.col("turn").alias("idx"), F.col("text").alias("source_text"))
    calls = s.select(F.col("id").alias("call_id"), F.lit("").alias("cache_key"), F.lit(False).alias("ok"), F.lit(0).alias("created_at"), F.lit(0.0).alias("cost"))
    g = values(spark, GLOSSARY).withColumn("target_aliases", F.array().cast("array<string>"))
    ran = batch.run(s, g, calls, "0" * 32).where(~T.trivially_empty(F.col("source_text")))
    return ran.select("id", "cache_key", F.sha2("target_text", 256).alias("target_sha256"), "n_violations", "status")
