"""Lore bundles, attachments, previews and replays."""

import json
import random

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text as T
from folioscope.operators import attachments, batch, replays, retrieval
from folioscope.sources import lorebook


def tables_of(spark):
    frame = spark.createDataFrame
    e, a, r, s = (lorebook.SCHEMAS[t] for t in ("entries", "aliases", "revisions", "sources"))
    entry = lambda i, p: (i, p, "term", f"s{i}", f"t{i}", None, "locked", 'a "note"\nhere', None, 1, 2, True)
    return {
        "entries": frame([entry("e1", "b"), entry("e2", "b"), entry("e3", "other")], e),
        "aliases": frame([("a1", "e1", "source", "x"), ("a2", "e3", "source", "y")], a),
        "revisions": frame([("r1", "e2", None, "t", None, 3)], r),
        "sources": frame([("s1", "b", "epub", "T", "p", 4), ("s2", "other", "epub", "T", "p", 4)], s),
    }


META = "id string, name string, source_lang string, target_lang string, description string, default_proposal_kind string, created_at bigint"


def test_lore_bundle(spark, tmp_path):
    path, parts = str(tmp_path / "b"), tables_of(spark)
    meta = spark.createDataFrame([("b", "N" * 100, "en", "de", None, "term", 1)], META)
    lorebook.export_lore("b", meta, parts, path, 9)
    got = lorebook.import_lore(spark, path, "new", 10)
    entries = {r["source_term"]: r for r in got["entries"].collect()}
    assert set(entries) == {"se1", "se2"} and {r["project_id"] for r in entries.values()} == {"new"}
    assert entries["se1"]["notes"] == 'a "note"\nhere' and entries["se1"]["id"] not in ("e1", "e2")
    assert [r["entry_id"] for r in got["aliases"].collect()] == [entries["se1"]["id"]]
    assert [r["entry_id"] for r in got["revisions"].collect()] == [entries["se2"]["id"]]
    assert got["sources"].count() == 1 and len(got["meta"].first()["name"]) == 80
    assert json.loads(got["events"].first()["payload_json"]) == {"source_id": "b", "entries": 2, "aliases": 1, "schema_version": 1}
    again = lorebook.import_lore(spark, path, "new", 10)
    assert sorted(r["id"] for r in again["entries"].collect()) == sorted(r["id"] for r in entries.values())
    kept = lorebook.import_lore(spark, path, "new", 10, preserve=True, name=" Mine ")
    assert {r["id"] for r in kept["entries"].collect()} == {"e1", "e2"} and kept["meta"].first()["name"] == "Mine"
    with pytest.raises(ValueError, match="not found"):
        lorebook.export_lore("none", meta, parts, str(tmp_path / "c"), 9)


def test_bundles_that_are_refused_and_references_outside(spark, tmp_path):
    for name, head in (("v", {"schema_version": 2, "name": "x"}), ("n", {"schema_version": 1})):
        (tmp_path / name / "meta").mkdir(parents=True)
        (tmp_path / name / "meta" / "m.json").write_text(json.dumps(head))
        with pytest.raises(ValueError):
            lorebook.import_lore(spark, str(tmp_path / name), "new", 1)
    parts = tables_of(spark)
    path = str(tmp_path / "w")
    meta = spark.createDataFrame([("b", "N", "en", "de", None, "term", 1)], META)
    lorebook.export_lore("b", meta, parts, path, 9)
    (tmp_path / "w" / "aliases" / "more.json").write_text(json.dumps({"id": "a9", "entry_id": "gone", "side": "source", "text": "z"}))
    assert {r["text"]: r["entry_id"] for r in lorebook.import_lore(spark, path, "n", 1)["aliases"].collect()}["z"] == "gone"


def test_attachments(spark):
    rng = random.Random(3)
    rows = []
    for seq in range(400):
        project = "hot" if seq % 3 else rng.choice(["a", "b", None])
        verb = rng.choice(["attach", "attach", "detach", "mode", "priority", "rename"])
        mode = rng.choice(["read_only", "propose"]) if verb == "mode" else rng.choice([None, "propose"])
        rows.append((project, seq, verb, f"l{rng.randrange(6)}", mode, rng.randrange(-5, 9) if verb == "priority" or rng.random() < 0.3 else None))
    shuffled = rng.sample(rows, len(rows))
    made = attachments.facts(spark.createDataFrame(shuffled, "project_id string, seq long, verb string, lore_id string, mode string, priority int").repartition(5))
    state, facts = {}, []
    for p, seq, verb, lore, mode, rank in rows:
        if p is None or verb == "rename":
            continue
        mine = state.setdefault(p, {})
        if verb == "attach" and lore not in mine:
            mine[lore] = {"mode": mode or "read_only", "priority": rank if rank is not None else 1 + max([x["priority"] for x in mine.values()] or [-1]), "at": seq}
            facts.append((p, seq, "lore.attached", False))
        elif lore in mine:
            if verb == "detach":
                del mine[lore]
                facts.append((p, seq, "lore.detached", None))
                continue
            if verb in ("attach", "mode") and mode is not None:
                mine[lore]["mode"] = mode
            if verb in ("attach", "priority") and rank is not None:
                mine[lore]["priority"] = rank
            facts.append((p, seq, {"attach": "lore.attached", "mode": "lore.mode_changed", "priority": "lore.priority_changed"}[verb], True if verb == "attach" else None))
    assert sorted((r["project_id"], r["seq"], r["kind"], r["updated"]) for r in made.collect()) == sorted(facts)
    after = sorted(tuple(r[c] for c in ("project_id", "lore_id", "mode", "priority", "attached_at")) for r in attachments.attached_after(made).collect())
    assert after == sorted((p, lore, x["mode"], x["priority"], x["at"]) for p, mine in state.items() for lore, x in mine.items())


ENTRIES = "id string, source_term string, target_term string, target_aliases array<string>, status string, source_known boolean"
CALLS = "call_id string, cache_key string, ok boolean, created_at long, model string, prompt_tokens long, completion_tokens long, response string"


def test_replays(spark):
    entries = spark.createDataFrame([("g", "cat", "Katze", [], "locked", True)], ENTRIES)
    trace = lambda t: json.dumps({"trace": {"target": t}})
    content = lambda c: json.dumps({"content": c})
    replies = {
        "k1": trace("die Katze"), "k2": trace("der Hund"), "k3": content('{"target": "eine Katze"}'), "k4": content("no reply"), "k5": "{}", "k6": trace("ohne"), "k7": trace("der der Katze"), "k8": content('so: {"target": "Katze"} !'), "k10": "not json",
    }
    calls = [(f"c{k}", k, True, 2, "m", 3, 4, r) for k, r in replies.items()] + [("early", "k1", True, 1, "m", 3, 4, trace("Katze zuerst")), ("bad", "k1", False, 0, "m", 3, 4, trace("x")), ("miss", "k9", False, 0, "m", 3, 4, trace("x"))]
    ask = [(f"s{k}", "a cat", f"k{k}", ["pair"] if k == 6 else []) for k in range(1, 11)] + [("none", "a cat", None, [])]
    got = replays.replayed(spark.createDataFrame(ask, "id string, source_text string, cache_key string, kinds array<string>"), spark.createDataFrame(calls, CALLS), entries, "de", 50)
    s = {r["id"]: r for r in got["segments"].collect()}
    assert {i: r["status"] for i, r in s.items()} == {"s1": "translated", "s2": "flagged", "s3": "translated", "s4": "failed", "s5": "failed", "s6": "failed", "s7": "flagged", "s8": "translated", "s10": "failed"}
    assert s["s1"]["target_text"] == "Katze zuerst" and s["s8"]["target_text"] == "Katze" and s["s6"]["target_text"] is None
    assert s["s4"]["error"] == "no JSON" and s["s5"]["error"] == replays.UNUSABLE and s["s6"]["error"].startswith("missing")
    rows = {r["segment_id"]: r for r in got["calls"].collect()}
    assert set(rows) == {"s1", "s2", "s3", "s7", "s8"} and all(r["cost_usd"] == 0 and r["cache_hit"] == 1 and r["duration_ms"] is None for r in rows.values())
    kinds = sorted((r["segment_id"], r["kind"]) for r in got["events"].collect())
    assert ("s2", "segment.flagged") in kinds and ("s1", "segment.flagged") not in kinds and len(kinds) == 7
    assert sorted(r["id"] for r in got["misses"].collect()) == ["none", "s9"]


def test_previews_have_the_keys_of_a_run(spark):
    rows = [(f"s{k}", k % 2, k, t) for k, t in enumerate(["one", "two", " ", "four [[T0]]", "[[T0]]", "six", "seven", "eight " * 100, "nine"])]
    s = spark.createDataFrame(rows, "id string, chapter long, idx long, source_text string")
    none = spark.createDataFrame([], CALLS)
    entries = spark.createDataFrame([], ENTRIES)
    ran = {r["id"]: r["cache_key"] for r in batch.run(s, entries, none.withColumnRenamed("response", "x").selectExpr("call_id", "cache_key", "ok", "created_at", "0.0D AS cost"), "h").collect() if r["cache_key"]}
    seen = replays.preview(s, none, "h").collect()
    assert {r["id"]: r["cache_key"] for r in seen} == ran and not any(r["cache_hit"] for r in seen)
    known = spark.createDataFrame([("c", ran["s5"], True, 1, "m", 1, 1, "{}")], CALLS)
    assert [(r["id"], r["hit_id"]) for r in replays.preview(s, known, "h").collect() if r["cache_hit"]] == [("s5", "c")]


def test_paths_and_inline_images(spark):
    hrefs = {"a%20b.png": "x/a b.png", "a+b.png": "x/a+b.png", "%zz.png": "x/%zz.png", "%ff.png": "x/%ff.png", "%C3%A9.png": "x/é.png", "../up.png#f": "up.png", "./%2e%2e/up.png": "up.png", "": "x"}
    got = spark.createDataFrame([(h,) for h in hrefs], "h string").select("h", T.resolve_path(F.lit("x/ch.html"), F.col("h")).alias("p")).collect()
    assert {r["h"]: r["p"] for r in got} == hrefs
    token = "struct<tag:string,kind:string,attrs:map<string,string>>"
    rows = [
        (1, "x/c.html", [("img", "void", {"src": "/i.png"}), ("img", "void", {"alt": "none"}), ("image", "void", {"src": " ", "xlink:href": "j.svg"}), ("img", "pair", {"src": "k.png"})]),
        (2, "c.html", [("img", "void", {"src": "DATA:x"}), ("img", "void", {"src": "//host/i.png"}), ("img", "void", {"href": "k.gif?1"})]), (3, None, None), (4, "c.html", []),
    ]
    s = spark.createDataFrame(rows, f"id long, chapter_href string, skeleton array<{token}>")
    out = retrieval.inline_images(s, spark.createDataFrame([("i.png",), ("i.png",), (None,)], "path string")).collect()
    assert sorted(tuple(r) for r in out) == [(1, 0, "i.png", "image/png", True), (1, 2, "x/j.svg", "image/svg+xml", False), (2, 2, "k.gif", "image/gif", False)]
