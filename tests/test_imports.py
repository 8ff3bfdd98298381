"""Imports against a loop over the incoming entries."""

import random

import pytest
from pyspark.sql import functions as F

from folioscope.operators import imports
from folioscope.plans import carry

ROW = "seq long, source_term string, type string, target_term string, status string, gender string, notes string, source_known boolean, source_aliases array<string>, target_aliases array<string>"
ENTRY = "id string, project_id string, source_term string, type string, target_term string, status string, gender string, notes string, source_known boolean, created_at long, updated_at long"


def dedup(term, words):
    out = []
    for w in words or []:
        if w and w != term and w not in out:
            out.append(w)
    return out


def loop(entries, aliases, incoming, policy, lore, now):
    """The import entry by entry; ids of new entries are numbers of their order."""
    entries, made = {e["id"]: dict(e) for e in entries}, 0
    words = {}
    for e, side, text in aliases:
        words.setdefault(e, {"source": [], "target": []})[side].append(text)
    log, outcomes, conflicts = [], [], []
    for r in sorted(incoming, key=lambda r: r["seq"]):
        alone = r["source_term"] is None or (lore and r["source_known"] is False)
        same = [i for i, e in entries.items() if not alone and e["project_id"] == "p" and e["source_term"] == r["source_term"] and e["type"] == r["type"]]
        got = {f: r[f] for f in imports.FIELDS}
        if not same:
            i, made = f"~{made:04}", made + 1
            term = None if alone else r["source_term"]
            entries[i] = got | {"id": i, "project_id": "p", "source_term": term, "type": r["type"], "source_known": not alone, "created_at": now, "updated_at": now}
            words[i] = {"source": dedup(term, r["source_aliases"]), "target": dedup(r["target_term"], r["target_aliases"])}
            outcomes.append((r["seq"], "created"))
            continue
        i = min(same)
        e = entries[i]
        outcomes.append((r["seq"], {"skip": "skipped", "overwrite": "updated", "collect": "conflict"}[policy]))
        if policy == "collect":
            there = {f: e[f] for f in imports.FIELDS} | {f"{s}_aliases": sorted(words.get(i, {}).get(s, [])) for s in imports.SIDES}
            conflicts.append((r["seq"], r["source_term"], r["type"], there, got | {f"{s}_aliases": dedup(None, r[f"{s}_aliases"]) for s in imports.SIDES}))
        elif policy == "overwrite":
            if any(e[f] != got[f] for f in imports.FIELDS):
                if e["target_term"] != got["target_term"] or e["status"] != got["status"]:
                    log.append((e["source_term"], e["type"], e["target_term"], got["target_term"]))
                e.update(got, updated_at=now)
            words[i] = {s: dedup(None, r[f"{s}_aliases"]) for s in imports.SIDES}
    return entries, words, log, outcomes, conflicts


def plain(e):
    return tuple(str(e[c]) for c in ("project_id", "source_term", "type", *imports.FIELDS, "source_known", "created_at", "updated_at"))


@pytest.mark.parametrize("policy", imports.POLICIES)
@pytest.mark.parametrize("lore", [False, True])
def test_imports_equal_the_loop(spark, policy, lore):
    rng = random.Random(f"{policy}{lore}")
    pick = lambda *xs: rng.choice(xs)
    some = lambda: [pick("", "a", "b", "c", "w1") for _ in range(rng.randrange(4))]
    entries = [
        {"id": f"e{k:02}", "project_id": pick("p", "p", "q"), "source_term": pick(None, *(f"w{j}" for j in range(12))), "type": pick("term", "place"), "target_term": pick("x", "y"),
         "status": pick("locked", "proposed"), "gender": pick(None, "f"), "notes": None, "source_known": True, "created_at": 1, "updated_at": 1}
        for k in range(30)
    ]
    aliases = sorted({(f"e{rng.randrange(30):02}", pick("source", "target"), pick("a", "b", "c")) for _ in range(40)})
    # a third of the rows is one term; rows without a term, with one that counts as unknown, exact repeats
    incoming = [
        {"seq": 7 * k, "source_term": "w3" if k % 3 == 0 else pick(None, *(f"w{j}" for j in range(20))), "type": pick("term", "place"), "target_term": pick("x", "y", "z"), "status": pick("locked", "proposed"),
         "gender": pick(None, "f"), "notes": pick(None, "n"), "source_known": pick(True, True, False, None), "source_aliases": pick(None, some()), "target_aliases": some()}
        for k in range(150)
    ]
    frame = lambda rows, schema: spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    unknown = F.coalesce(~F.col("source_known"), F.lit(False)) if lore else None
    got = imports.imported(
        frame(entries, ENTRY), spark.createDataFrame([(*a, f"a{k}") for k, a in enumerate(aliases)], "entry_id string, side string, text string, id string"),
        spark.createDataFrame([], "id string, entry_id string, prev_target_term string, new_target_term string, reason string, created_at long"), frame(incoming, ROW), "p", policy, 99, unknown=unknown,
    )
    want, words, log, outcomes, conflicts = loop(entries, aliases, incoming, policy, lore, 99)
    rows = {r["id"]: r.asDict() for r in got["entries"].collect()}
    assert sorted(map(plain, rows.values())) == sorted(map(plain, want.values()))
    lists = {}
    for a in got["aliases"].collect():
        lists.setdefault(a["entry_id"], []).append((a["side"], a["text"]))
    flat = lambda i, w: sorted((s, t) for s in imports.SIDES for t in w.get(i, {}).get(s, []))
    assert sorted((plain(e), sorted(lists.get(i, []))) for i, e in rows.items()) == sorted((plain(e), flat(i, words)) for i, e in want.items())
    steps = [(rows[r["entry_id"]]["source_term"], rows[r["entry_id"]]["type"], r["prev_target_term"], r["new_target_term"]) for r in got["revisions"].collect()]
    assert sorted(steps) == sorted(log)
    assert sorted((r["seq"], r["outcome"]) for r in got["outcomes"].collect()) == outcomes
    seen = sorted(((r["seq"], r["source_term"], r["type"], r["existing"].asDict(), r["incoming"].asDict()) for r in got["conflicts"].collect()), key=lambda c: c[0])
    assert seen == conflicts
    n = imports.summary(got["outcomes"]).first().asDict()
    assert sum(n.values()) == len(incoming)


def test_empty_import_and_unknown_policy(spark):
    e, a = spark.createDataFrame([], ENTRY), spark.createDataFrame([], "id string, entry_id string, side string, text string")
    r = spark.createDataFrame([], "id string, entry_id string, prev_target_term string, new_target_term string, reason string, created_at long")
    got = imports.imported(e, a, r, spark.createDataFrame([], ROW), "p", "overwrite", 1)
    assert all(t.count() == 0 for t in got.values())
    with pytest.raises(ValueError):
        imports.placed(e, spark.createDataFrame([], ROW), "p", "merge")


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_the_row_before_over_ranges(spark, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice([None, "a", "a", "a", "b"]), k * 3, rng.choice([None, k])) for k in range(200)]
    got = carry.before(spark.createDataFrame(rows, "k string, o long, v long"), ["k"], "o", ["o", "v"], "p", ranges).collect()
    prev, want = {}, {}
    for k, o, v in rows:
        want[o] = prev.get(k)
        prev[k] = (o, v)
    assert {r["o"]: r["p"] and tuple(r["p"]) for r in got} == want
