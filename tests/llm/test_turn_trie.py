import hashlib
import random
import zlib

import numpy as np
import pytest

from twinfold.llm import oracle, turn_trie

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda t: hashlib.md5(f"{len(t[2])}:{t[2]}{t[3]}".encode()).digest()
    own = {c: [t[2:] for t in sorted(ts, key=lambda t: (t[0], t[1], digest(t)))] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
        ends.setdefault(path, []).append(c)
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for path in members:
        if path:
            kids[path[:-1]] += 1
    for path, of in members.items():
        cost = (len(of) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += not kids[path]
            saved[path[:d]] += cost
    return sorted((min(of), len(p), min(members[p[:-1]]) if p else None, len(of), kids[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()) for p, of in members.items())


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return sorted(tuple(r[c] for c in COLUMNS) for r in turn_trie.trie(spark, df, **kw).collect())


def talk(seed, n, most=12, kinds=2):
    rng = random.Random(seed)
    texts = ["é", "b", "c c", "", None][:kinds + 1]
    rows = []
    for c in rng.sample(range(3 * n), n):
        for t in range(rng.randint(1, most)):
            rows.append((c, t, rng.choice(["user", "assistant", None]) if rng.random() < .1 else "user", rng.choice(texts)))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,shard", [(1, 1 << 20), (2, 20), (3, 3)])
def test_equals_brute_force(spark, seed, shard):
    rows = talk(seed, 60)
    assert run(spark, rows, shard_nodes=shard) == brute(rows)


def test_copies_hot_first_turn_long_conversation_and_spilling_queue(spark, monkeypatch):
    monkeypatch.setattr(turn_trie, "QUEUE_ROWS", 4)
    monkeypatch.setattr(turn_trie, "PIECE_BITS", 3)
    monkeypatch.setattr(turn_trie, "ENDS_PER_PIECE", 7)
    rows = [(c, t, "user", f"same {t}") for c in range(100, 160) for t in range(9)]
    rows += [(c, t, "user", "hello" if t < 9 else f"{c} {t}") for c in range(200, 240) for t in range(12)]
    rows += [(5, t, "user", f"long {t % 3}") for t in range(300)] + [(8, t, "user", f"long {t % 3}") for t in range(290)]
    assert run(spark, rows, shard_nodes=40) == brute(rows)


def test_nulls_ties_repeats_gaps_and_absent_bases(spark):
    rows = [(None, 1, "user", "x"), (1, None, "user", "first"), (1, None, "user", "also"), (1, 3, None, None), (1, 3, "", ""),
            (1, 2, "a", "bc"), (2, 2, "ab", "c"), (3, 10_000_000, "u", "v"), (3, -5, "u", "w"), (7, 0, "u", "w"), (7, 0, "u", "w"),
            (10, 4, "u", "w"), (11, 1, "u", "gone"), (12, 1, "u", "w" * 100_000)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, 0, "u", "t", 5, "z")], "conv_id long, turn long, role string, text string, depth long, k string")
    assert turn_trie.trie(spark, df).count() == len(brute([(1, 0, "u", "t")]))


def test_queue_merges_spilled_runs_in_order():
    rng = np.random.default_rng(1)
    queue = turn_trie.Messages(2, limit=50)
    want = {}
    for _ in range(40):
        keys = rng.integers(0, 300, 20)
        queue.put(keys, np.ones(20, int), keys * 2)
        for k in keys.tolist():
            want[k] = (want.get(k, (0, 0))[0] + 1, want.get(k, (0, 0))[1] + 2 * k)
    assert len(queue.take(1000)) == 0
    queue.next_level()
    got = [tuple(r) for last in (10, 10, 57, 200, 1000) for r in queue.take(last).tolist()]
    assert got == [(k, *want[k]) for k in sorted(want)]


def test_table_and_sql(spark, sf):
    import duckdb

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{sf}/conversations.parquet')")
    found = con.execute(f"SELECT {', '.join(COLUMNS)} FROM ({oracle.OP13})").fetchall()
    assert run(spark, rows) == brute(rows) == sorted(found)
