"""Live views against plain loops, after every micro-batch and over a stop; chained summaries."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope import queries as Q
from folioscope.operators import summaries
from folioscope.streaming import live

SF = "/root/testdata/sf0.001"


def shown(rows):
    """The inbox by a loop over log rows in order."""
    status, note = {}, {}
    for key, _, s, n in sorted(rows, key=lambda r: r[1]):
        status[key] = s if s is not None else status.get(key)
        note[key] = n if n is not None else note.get(key)
    return {k: note.get(k) for k, s in status.items() if s == "flagged"}


def totals(rows, base):
    """Runs by a loop over log rows in order."""
    out = {}
    for run, _, kind, ms in sorted(rows, key=lambda r: r[1]):
        r = out.setdefault(run, {**dict.fromkeys([*live.OUTCOMES, "skipped", "elapsed_ms"], 0), **base.get(run, {}), "phase": "running"})
        if kind == "cancelled":
            r["phase"] = kind
        elif kind in ("paused", "resumed") and r["phase"] != "cancelled":
            r["phase"] = "paused" if kind == "paused" else "running"
        elif kind in live.OUTCOMES:
            r[kind if r["phase"] == "running" else "skipped"] += 1
            r["elapsed_ms"] += (ms or 0) if r["phase"] == "running" else 0
    return out


def put(spark, rows, schema, path, n):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/log/f={n}")


def view(spark, path, df, key):
    return live.latest(live.changes(spark, path, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)), key).collect()


def test_inbox_withdraws_rows_after_every_batch(spark, tmp_path):
    rng, path, schema = random.Random(3), str(tmp_path), "k int, at bigint, s string, n string"
    rows = [(rng.randrange(12), i, rng.choice(["flagged", "approved", None, "pending"]), rng.choice([None, None, f"note {i}"])) for i in range(240)]
    late = rows[:]
    for i in range(0, 240, 40):  # some rows come a file late
        late[i : i + 30] = rng.sample(late[i : i + 30], 30)
    for n in range(6):
        put(spark, [*late[n * 40 : n * 40 + 40], (None, 1, "flagged", "no key")], schema, path, n)
        df = live.inbox(live.events(spark, f"{path}/log/f=*", schema), "k", "at", "s", "n")
        live.to_changes(df, "update", path, f"inbox{n}").awaitTermination()
        assert {r["k"]: r["note"] for r in view(spark, path, df, "k") if r["shown"]} == shown(late[: n * 40 + 40])
    log = live.changes(spark, path, "k int, seq bigint, shown boolean, note string")
    assert log.where("not shown").count() > 5 and log.where("k is null").count() == 0


def test_runs_stop_and_resume(spark, tmp_path):
    rng, schema = random.Random(5), "run int, at bigint, kind string, ms bigint"
    kinds = [*live.OUTCOMES * 6, "paused", "resumed", "resumed", "cancelled", None, "other"]
    rows = [(rng.randrange(20), i, rng.choice(kinds), rng.choice([None, 5, 70])) for i in range(400)]
    base = {3: {"translated": 7, "cached": 1, "flagged": 0, "failed": 2, "elapsed_ms": 900}, 99: {"translated": 1, "cached": 0, "flagged": 0, "failed": 0, "elapsed_ms": 1}}
    b = spark.createDataFrame([(k, *(v[c] for c in [*live.OUTCOMES, "elapsed_ms"])) for k, v in base.items()], "run int, translated bigint, cached bigint, flagged bigint, failed bigint, elapsed_ms bigint")
    whole, parted = str(tmp_path / "whole"), str(tmp_path / "parted")
    for n in range(4):
        put(spark, rows[n * 100 : n * 100 + 100], schema, parted, n)
        if n == 2:
            put(spark, rows[100:200], schema, parted, "twice")  # a file that is sent again changes nothing
        df = live.runs(live.events(spark, f"{parted}/log/f=*", schema, files_per_trigger=1), "run", "at", "kind", "ms", b)
        live.to_changes(df, "update", parted, f"runs{n}").awaitTermination()  # every call is a stop and a resume
    put(spark, rows, schema, whole, 0)
    df = live.runs(live.events(spark, f"{whole}/log/f=*", schema), "run", "at", "kind", "ms", b)
    live.to_changes(df, "update", whole, "runs").awaitTermination()
    as_dict = lambda path: {r["run"]: {c: r[c] for c in [*live.OUTCOMES, "skipped", "elapsed_ms", "phase"]} for r in view(spark, path, df, "run")}
    want = totals(rows, base)
    assert as_dict(whole) == want and as_dict(parted) == want
    assert {r["phase"] for r in want.values()} == {"running", "paused", "cancelled"}


def test_a_batch_written_twice_counts_once(spark, tmp_path):
    path = str(tmp_path)
    spark.range(3).withColumn("v", F.lit(1)).write.mode("overwrite").parquet(f"{path}/changes/batch=0")
    spark.range(2).withColumn("v", F.lit(2)).write.mode("overwrite").parquet(f"{path}/changes/batch=1")
    spark.range(2).withColumn("v", F.lit(2)).write.mode("overwrite").parquet(f"{path}/changes/batch=1")
    rows = live.changes(spark, path, "id bigint, v int")
    assert rows.count() == 5 and {r["id"]: r["v"] for r in live.latest(rows, "id").collect()} == {0: 2, 1: 2, 2: 1}


def test_progress(spark):
    rows = spark.createDataFrame([(1, 2, 1, 0, 1, 2000), (2, 0, 0, 0, 0, 0)], "run int, translated bigint, cached bigint, flagged bigint, failed bigint, elapsed_ms bigint")
    a, b = live.progress(rows, F.lit(6)).orderBy("run").collect()
    assert (a["done"], a["total"], a["rate"], a["eta_s"]) == (4, 10, 2.0, 3.0)
    assert (b["done"], b["total"], b["rate"], b["eta_s"]) == (0, 6, None, None)


def test_chain_of_summaries(spark):
    parts = [("a", 1, "one"), ("a", 3, "bad"), ("a", 2, " two\n"), ("a", 4, "three"), ("b", 1, ""), ("b", 2, None), ("b", 5, "bad"), (None, 1, "lone"), (None, 2, "end")]
    df = spark.createDataFrame(parts, "book string, n int, t string").withColumn("part", F.lit(9))
    reply = lambda u: F.when(~u.contains("bad"), F.concat(F.lit("<"), F.replace(u, F.lit("\n"), F.lit("/")), F.lit(">")))
    got = summaries.chained(df, "book", "n", "t", reply, "m", "h")
    rows = {(r["book"], r["n"]): r for r in got.collect()}
    first = "<Next part:/one>"
    second = f"<Summary so far:/{first}//Next part:/two>"
    assert sorted(rows, key=str) == sorted([("a", 1), ("a", 2), ("a", 3), ("a", 4), ("b", 5), (None, 1), (None, 2)], key=str)
    assert rows["a", 1]["prior"] is None and rows["a", 1]["summary"] == first and rows["a", 2]["prior"] == first and rows["a", 2]["summary"] == second
    assert rows["a", 3]["status"] == "failed" and rows["a", 3]["summary"] is None and rows["a", 4]["prior"] == second
    assert rows[None, 2]["prior"] == "<Next part:/lone>"
    books = {r["book"]: r for r in summaries.of_books(got, "book").collect()}
    assert books["a"]["summary"] == rows["a", 4]["summary"] and books["a"]["failed"] == 1 and books["b"]["error"] == "all summary chunks failed" and books["b"]["summary"] is None
    # a changed part makes new keys from there on, and none before
    edited = df.withColumn("t", F.when((F.col("book") == "a") & (F.col("n") == 2), "zwei").otherwise(F.col("t")))
    again = {(r["book"], r["n"]): r["status"] for r in summaries.chained(edited, "book", "n", "t", reply, "m", "h", summaries.as_calls(got)).collect()}
    assert again == {("a", 1): "cached", ("a", 2): "called", ("a", 3): "failed", ("a", 4): "called", ("b", 5): "failed", (None, 1): "cached", (None, 2): "cached"}


def test_no_parts(spark):
    got = summaries.chained(spark.createDataFrame([], "book string, n int, t string"), "book", "n", "t", lambda u: u, "m", "h")
    assert got.count() == 0 and summaries.of_books(got, "book").count() == 0


@pytest.mark.parametrize("name", ["live_inbox", "live_runs"])
def test_live_queries_equal_the_loops(spark, name):
    log = spark.read.parquet(f"{SF}/events.parquet")
    got = Q.QUERIES[name](spark, SF).collect()
    if name == "live_inbox":
        assert {r["user_id"]: r["note"] for r in got} == shown([tuple(r) for r in Q.inbox_log(log).collect()])
    else:
        base = {r["run"]: {c: r[c] for c in [*live.OUTCOMES, "elapsed_ms"]} for r in Q.run_baseline(spark, SF).collect()}
        want = totals([tuple(r) for r in Q.run_log(log).collect()], base)
        assert {r["run"]: {c: r[c] for c in next(iter(want.values()))} for r in got} == want
