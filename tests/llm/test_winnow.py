import hashlib
import random

from twinfold.llm import winnow
from twinfold.llm.textblocks import RangeHash


def brute_marks(text, k, window):
    import numpy as np

    h = RangeHash(301)

    def value(s):
        p = h.prefix(np.frombuffer(s.encode(), np.uint8))
        return int(h.ranges(p, np.array([0]), np.array([len(s.encode())]))[0]) >> 32

    if not text:
        return []
    if len(text) < k:
        return [(0, value(text))]
    grams = [value(text[i:i + k]) for i in range(len(text) - k + 1)]
    chosen = set()
    for i in range(max(1, len(grams) - window + 1)):
        win = grams[i:i + window]
        chosen.add(i + max(j for j, g in enumerate(win) if g == min(win)))
    return [(i, grams[i]) for i in sorted(chosen)]


def texts(seed):
    rng = random.Random(seed)
    vocab = ["the", "é", "ñandú", "a", "😀", "\n", "of"] + [f"w{i}" for i in range(30)]
    out = [None, "", "a", "é", "short text", "aaaa" * 60, "ab" * 200]
    return out + [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 150))) for _ in range(40)]


def test_marks_match_brute_force(spark):
    rows = list(enumerate(texts(1)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, window in ((24, 64), (3, 5), (8, 1)):
        got = {r.doc_id: [(m.pos, m.hash) for m in r.fingerprint] for r in winnow.fingerprints(df, k=k, window=window).collect()}
        assert got == {d: brute_marks(t, k, window) for d, t in rows}


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(winnow, "_PIECE", 90)
    rows = list(enumerate(texts(2)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(m.pos, m.hash) for m in r.fingerprint] for r in winnow.fingerprints(df, k=6, window=20).collect()}
    assert got == {d: brute_marks(t, 6, 20) for d, t in rows}


def brute_edited(rows, k=winnow.K, window=winnow.WINDOW):
    order = sorted(rows, key=lambda r: ((r[0] is None), -(r[0] or 0), r[1] or ""))
    out = []
    for i, (d, t) in enumerate(order):
        t, n = t or "", order[(i + 1) % len(order)][1] or ""
        c = len(t) // 3
        e = t[:len(t) - c] + n[:c]
        sets = [{h for _, h in brute_marks(x, k, window)} for x in (t, e, n)]
        like = lambda a, b: len(a & b) / len(a | b) if a or b else 1.0
        text = "".join(f"{h:08x}" for _, h in brute_marks(t, k, window))
        out.append((d, len(t), hashlib.sha256(e.encode()).hexdigest(), text,
                    "".join(f"{h:08x}" for _, h in brute_marks(e, k, window)), like(*sets[:2]), like(sets[0], sets[2])))
    return sorted(out, key=str)


def test_edited_neighbours(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(10**6) if i % 3 else i, t) for i, t in enumerate(texts(3) + texts(4))]
    rows += [(None, "no id here"), (5, "tie b"), (5, "tie a"), (10**6 + 5, "top one"), (10**6 + 5, "another top")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for chunk in (1 << 20, 50):
        got = sorted((tuple(r) for r in winnow.edited_neighbours(df, chunk_bytes=chunk).collect()), key=str)
        assert got == brute_edited(rows)


def test_few_rows(spark):
    for rows in ([], [(1, "only one document " * 9)], [(1, "x" * 90), (2, "y" * 90)], [(None, "a" * 40)], [(4, "q"), (4, "q")]):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted((tuple(r) for r in winnow.edited_neighbours(df).collect()), key=str) == brute_edited(rows)


def test_equal_texts_have_equal_fingerprints_and_columns_may_clash(spark):
    df = spark.createDataFrame([(1, "t " * 90, 4), (2, "t " * 90, 5)], "doc_id long, text string, fingerprint int")
    rows = winnow.fingerprints(df).collect()
    assert rows[0].fingerprint == rows[1].fingerprint and rows[0].fingerprint
