"""The pipeline's stages on odd rows and on a small table."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("component_id", F.lit("own")).withColumn("size", F.lit(1))
    n = docs.count()
    for name, step in pipeline.STAGES[:-1]:
        got = step(spark, docs, SF)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes, name
        assert got.count() > 0.5 * n, name


def test_run(spark):
    out = pipeline.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "sequence_id", "offset", "length"} <= set(out.columns)


def test_empty_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = docs.limit(40).unionByName(spark.createDataFrame([(None, None, None, None, None), (5, "", None, None, 0)], docs.schema))
    for _, step in pipeline.STAGES:
        step(spark, odd, SF).count()
        assert step(spark, docs.where("false"), SF).count() == 0


def test_rows_without_ids_and_repeated_rows(spark):
    """Exact and near dedup keep one row of each group whatever the ids; clashing names are left alone."""
    text = "the quick brown fox jumps over the lazy dog while nine tall giants walk along the river bank " * 4
    rows = [(1, text), (1, text), (None, text + " one more"), (None, "another text that is long enough to be told apart from all of the others here"), (2, "short")]
    rows += [(None, rows[3][1])]
    df = spark.createDataFrame([(*r, "en", "web", 1) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("_kept_id", "_mix_n", "_text", "row", "at", "doc", "copy", "node", "kept"):
        df = df.withColumn(c, F.lit("own"))
    exact = pipeline.drop_exact(spark, df, SF)
    assert sorted((str(r["doc_id"]), r["text"]) for r in exact.collect()) == sorted([("1", text), ("None", rows[2][1]), ("None", rows[3][1]), ("2", "short")]) and exact.columns == df.columns
    near = pipeline.drop_near(spark, df, SF)
    assert sorted((str(r["doc_id"]), r["text"]) for r in near.collect()) == sorted([("1", text), ("None", rows[3][1]), ("2", "short")]) and near.columns == df.columns
    mixed = pipeline.mix_sources(spark, df, SF)
    assert mixed.columns == df.columns and {r["doc_id"] for r in mixed.collect()} == {1, 2, None}
    assert pipeline.keep_identified(spark, df, SF).columns == df.columns


def test_whole_copies_come_near_the_words_taken(spark):
    rows = [(k, f"s{k % 3}" if k % 3 else None, 1 + k * 37 % 900) for k in range(3000)]
    share = {0: 0.4, 1: 0.76, 2: 1.6}
    mixed = spark.createDataFrame([(k, s, n, int(n * share[k % 3])) for k, s, n in rows if int(n * share[k % 3])], "doc_id long, source string, size long, taken long")
    got = pipeline.whole_copies(mixed, 3000).collect()
    assert all(r["taken"] // r["size"] <= r["times"] <= r["taken"] // r["size"] + 1 for r in got)
    for k in share:
        mine = [r for r in got if r["doc_id"] % 3 == k]
        want = sum(r["taken"] for r in mine)
        assert abs(sum(r["times"] * r["size"] for r in mine) - want) < 0.02 * want


def test_row_numbers_hold_however_files_are_split(spark, tmp_path):
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat(cast(id AS string), 60) AS text", "'x' AS source", "id % 3 AS no", "id AS file", "1 AS at")
    docs.repartition(7).write.parquet(f"{tmp_path}/documents")
    seen, before = [], spark.conf.get("spark.sql.leafNodeDefaultParallelism", None)
    for n in ("2", "64"):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", n)
        rows = pipeline.numbered(spark.read.parquet(f"{tmp_path}/documents")).select("doc_id", "row", "doc.file").collect()
        seen.append({r["doc_id"]: (r["row"], r["file"]) for r in rows})
    spark.conf.unset("spark.sql.leafNodeDefaultParallelism") if before is None else spark.conf.set("spark.sql.leafNodeDefaultParallelism", before)
    assert seen[0] == seen[1] and len({x for x, _ in seen[0].values()}) == 20_000
