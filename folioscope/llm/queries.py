"""The queries of this subpackage: thin uses of its operators over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from folioscope.llm import alignment, bpe, exact, langid, lattice, mixing, packing, passages, periodic, quality, simhash, suffix, vectors
from folioscope.llm.common import LOWER, UPPER, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, distance=2)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(langid.crc_mod(F.col("doc_id"), 5) != 0), "doc_id", "text", "quality")
    out = quality.score(docs, model).withColumn("held_out", langid.crc_mod(F.col("doc_id"), 5) == 0)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.9)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), length=100)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, most=2.0)
    return out.select("doc_id", "size", "source_size", "target", "taken")


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", langid.crc_mod(F.col("doc_id"), 4) == 2)
    out = langid.identify(docs.select("doc_id", "text", "held_out"), docs.where("not held_out"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op7_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.score(table(spark, sf_dir, "documents"), held_mod=7, held_at=2)


def op8_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.dedup(table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), capacity=2048)


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.near_passages(table(spark, sf_dir, "documents"), words=50, similar=0.8)


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.decode(bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return out.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = periodic.periodic_runs(periodic.with_planted_periods(table(spark, sf_dir, "documents")), least=6, times=4)
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    out = out.withColumn("top", periodic.strongest(F.col("runs")))
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", F.transform("runs", line)).cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality, op3_embeddings, op4_suffix, op5_mixing, op6_langid, op7_lattice, op8_exact, op9_packing, op10_passages, op11_bpe, op12_alignment, op13_periodic)}

ORACLE_SQL = {
    "op3_embeddings": """
        WITH RECURSIVE v AS (
            SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(embedding) > 0
              AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
              AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
        link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
                 WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
        walk AS (SELECT vec_id AS a, vec_id AS b FROM embeddings
                 UNION SELECT w.a, l.b FROM walk w JOIN link l ON w.b = l.a),
        low AS (SELECT a, min(b) AS c FROM walk GROUP BY a),
        n AS (SELECT a, count(*) AS n FROM link GROUP BY a)
        SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, low.c AS component_id, e.vec_id = low.c AS kept
        FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op8_exact": f"""
        WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) AS h FROM documents),
        g AS (SELECT h, max(doc_id) AS keep_id, count(*) AS n FROM d GROUP BY h)
        SELECT d.doc_id, g.keep_id, CAST(g.n AS BIGINT) AS group_size, d.doc_id = g.keep_id AS kept, d.h AS text_sha256
        FROM d JOIN g USING (h)""",
}
