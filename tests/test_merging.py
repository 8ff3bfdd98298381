"""Merges against a loop over winners and losers."""

import random

from folioscope.operators import merging


def loop(entries, aliases, mentions, revisions, pairs, now):
    entries, mentions = {e[0]: list(e) for e in entries}, [list(m) for m in mentions]
    aliases, revisions = [a[:3] for a in aliases], [r[1:] for r in revisions]
    own = lambda i: {("source", entries[i][1]), ("target", entries[i][2])} | {a[1:] for a in aliases if a[0] == i}
    for winner in sorted({w for w, _ in pairs}):
        done = False
        for loser in sorted(x for w, x in pairs if w == winner):
            if loser == winner or loser not in entries or winner not in entries:
                continue
            for word in sorted(x for x in own(loser) - own(winner) if x[1]):
                aliases.append((winner, *word))
            for m in mentions:
                m[1] = winner if m[1] == loser else m[1]
            aliases, revisions = [a for a in aliases if a[0] != loser], [r for r in revisions if r[0] != loser]
            del entries[loser]
            done = True
        if done:
            revisions.append((winner, entries[winner][2], entries[winner][2], "merge", now))
            entries[winner][3] = now
    return sorted(entries.values()), sorted(aliases), sorted(mentions), sorted(revisions, key=str)


def test_merges_equal_the_loop(spark):
    rng = random.Random(8)
    words = ["", *(f"w{k}" for k in range(9))]
    entries = [(f"e{k:02}", rng.choice([None, *words]), rng.choice(words), 5) for k in range(40)]
    aliases = sorted({(f"e{rng.randrange(42):02}", rng.choice(["source", "target"]), rng.choice(words[1:])) for _ in range(120)})
    mentions = [(k, f"e{rng.randrange(42):02}", "x") for k in range(200)]
    revisions = [(f"r{k}", f"e{rng.randrange(42):02}", "a", "b", None, k) for k in range(60)]
    # winners are the tens; a hot winner, an entry with itself, unknown ones on both sides, a pair twice
    pairs = [("e00", f"e{k:02}") for k in range(1, 10)] + [("e10", "e11"), ("e10", "e11"), ("e10", "e10"), ("e10", "e98"), ("e99", "e12"), ("e20", "e21"), ("e30", "e30")]
    frame = spark.createDataFrame
    got = merging.merged(
        frame(entries, "id string, source_term string, target_term string, updated_at bigint"),
        frame([(*a, f"a{k}") for k, a in enumerate(aliases)], "entry_id string, side string, text string, id string"),
        frame(mentions, "m int, entry_id string, note string"),
        frame(revisions, "id string, entry_id string, prev_target_term string, new_target_term string, reason string, created_at bigint"),
        frame(pairs, "winner_id string, loser_id string"), 77,
    )
    want = loop(entries, aliases, mentions, revisions, sorted(set(pairs)), 77)
    rows = lambda name, *cols: [tuple(r) for r in got[name].select(*cols).collect()]
    assert sorted(rows("entries", "id", "source_term", "target_term", "updated_at")) == [tuple(e) for e in want[0]]
    assert sorted(rows("aliases", "entry_id", "side", "text")) == want[1]
    assert sorted(rows("mentions", "m", "entry_id", "note")) == [tuple(m) for m in want[2]]
    assert sorted(rows("revisions", "entry_id", "prev_target_term", "new_target_term", "reason", "created_at"), key=str) == want[3]
    ids = [r[0] for r in rows("aliases", "id")]
    assert None not in ids and len(set(ids)) == len(ids) and len({r[0] for r in rows("revisions", "id")}) == got["revisions"].count()


def test_an_entry_that_wins_and_loses_is_kept(spark):
    entries = spark.createDataFrame([("a", "A", "1"), ("b", "B", "2"), ("c", "C", "3")], "id string, source_term string, target_term string")
    pairs = spark.createDataFrame([("a", "b"), ("b", "c")], "winner_id string, loser_id string")
    assert [tuple(r) for r in merging.agreed(pairs, entries).collect()] == [("b", "c")]
    assert merging.agreed(pairs.limit(0), entries).count() == 0
