import random
import re

import xxhash

from twinfold.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(prints):
        groups.setdefault(find(i), []).append(d)
    return sorted((d if d is not None else -1, f"{f:016x}", min((x for x in groups[find(i)] if x is not None), default=None))
                  for i, (d, f) in enumerate(prints))


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = simhash.near_duplicates(spark, df, **kw).select("doc_id", simhash.hex_fingerprint().alias("f"), "component_id")
    return sorted((r[0] if r[0] is not None else -1, r[1], r[2]) for r in out.collect())


def near_copies(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}é" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n\t "), (3, "One two"), (4, "one TWO"), (5, "x " * 5000), (None, "one two"),
            (None, "all alone here is no one else"), (7, "dup"), (7, "dup")]
    bases = [[rng.choice(vocab) for _ in range(rng.randint(30, 200))] for _ in range(n // 8)]
    for d in range(10, 10 + n):
        words = list(rng.choice(bases))
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = rng.choice(vocab)
        rows.append((d, rng.choice([" ", "\n"]).join(words)))
    return rows


def test_matches_brute_force(spark):
    rows = near_copies(1, 300)
    assert got(spark, rows) == brute_components(rows)


def test_crowded_cells_are_cut_without_loss(spark):
    rows = near_copies(2, 200)
    assert got(spark, rows, cell_rows=5) == brute_components(rows)


def test_empty_table_and_extra_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e", 9, 9), (2, "a b c d e", 9, 9)],
                               "doc_id long, text string, fp long, component_id long")
    assert {r.component_id for r in simhash.near_duplicates(spark, df).collect()} == {1}


def test_links_at_every_distance(spark):
    rng = random.Random(3)
    fps = []
    for _ in range(60):
        a = rng.getrandbits(64)
        fps.append(a)
        for k in (1, 3, 4, 5, 6):
            b = a
            for bit in rng.sample(range(64), k):
                b ^= 1 << bit
            fps.append(b)
    rows = list(enumerate(f - (1 << 64) if f >= 1 << 63 else f for f in fps))
    classes = spark.createDataFrame([(f, i) for i, f in rows], "fp long, cid long")
    want, parent = {}, list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    want = {i: find(i) for i in range(len(fps)) if find(i) != i}
    from twinfold.llm.components import components

    for cell_rows in (4096, 3):
        found = components(spark, simhash.links(spark, classes, cell_rows=cell_rows))
        assert {r.node: r.root for r in found.collect()} == want
