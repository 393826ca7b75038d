import collections
import hashlib
import random

import pytest

from twinfold.llm import suffix_dedup as sd


def brute(rows, t):
    seen = collections.Counter()
    texts = [(d, (x or "").encode()) for d, x in rows]
    for _, x in texts:
        seen.update(x[i:i + t] for i in range(len(x) - t + 1))
    out = []
    for d, x in texts:
        gone = bytearray(len(x))
        for i in range(len(x) - t + 1):
            if seen[x[i:i + t]] > 1:
                gone[i:i + t] = b"\1" * t
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(c for c, g in zip(x, gone) if not g)
        out.append((d, len(x), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((tuple(r) for r in sd.digest(sd.remove_repeats(spark, df, **kw)).collect()), key=str)


def corpus(seed, passage=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "ñandú", "to", "a", "inth", "\n", "ß"] + [f"w{i}" for i in range(60)]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    shared = [text(passage) for _ in range(6)]
    rows = [(0, None), (1, ""), (2, "short"), (3, "ab" * 400), (4, "z" * 500), (5, text(900))]
    for d in range(10, 60):
        parts = [text(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            s = rng.choice(shared)
            a = rng.randint(0, len(s) // 2)
            parts += [s[a:a + rng.randint(20, len(s))], text(rng.randint(0, 40))]
        rows.append((d, "".join(parts)))
    return rows + [(100, rows[20][1]), (101, rows[20][1]), (102, rows[30][1] + "x"), (103, "y" + rows[30][1])]


@pytest.mark.parametrize("threshold,gram,light", [(200, 64, 500), (200, 32, 2), (50, 16, 1), (40, 40, 5)])
def test_matches_brute_force(spark, threshold, gram, light):
    rows = corpus(threshold)
    assert got(spark, rows, threshold=threshold, gram=gram, light=light) == brute(rows, threshold)


def test_crowded_pieces(spark):
    rows = corpus(12)
    assert got(spark, rows, light=1, crowded=1) == brute(rows, 200)
    assert got(spark, rows, light=2, crowded=3, threshold=60, gram=20) == brute(rows, 60)


def test_a_long_list_of_heavy_pieces_raises_the_bound(spark):
    rows = corpus(11)
    assert got(spark, rows, light=1, heavy_list=3) == brute(rows, 200)


def test_more_heavy_pieces_than_may_be_broadcast(spark):
    rows = corpus(13)
    assert got(spark, rows, light=2, heavy_list=2, crowded=4, threshold=60, gram=20) == brute(rows, 60)
    # One piece holds a third of the anchors; the list that is broadcast stays within its bound and nothing is lost.
    counts = [(0, 500)] + [(g, 3 + g % 90) for g in range(1, 60)] + [(g, 2) for g in range(100, 120)]
    twice = spark.createDataFrame(counts, "gram long, n long")
    for bound in (1, 5, 20, 59):
        hottest, others = sd._heavy_pieces(twice, 2, bound)
        hot, rest = ({r.gram for r in t.collect()} for t in (hottest, others))
        assert len(hot) <= bound and not hot & rest and hot | rest == {g for g, n in counts if n > 2}
        assert all(n * bound <= sum(n for _, n in counts if n > 2) for g, n in counts if g in rest)
    hottest, others = sd._heavy_pieces(twice, 2, 60)
    assert others is None and hottest.count() == 60
    assert sd._heavy_pieces(twice.where("n < 0"), 2, 5)[1] is None


def test_repeated_and_null_ids(spark):
    rows = corpus(7) + [(10, "tail " * 100), (None, "q" * 450), (None, corpus(7)[15][1])]
    assert got(spark, rows) == brute(rows, 200)


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(sd, "_PIECE", 700)
    rows = corpus(9, passage=200)
    assert got(spark, rows) == brute(rows, 200)


def test_empty_table_and_extra_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "k" * 300, 5, "x")], "doc_id int, text string, row_id int, spans string")
    row = sd.remove_repeats(spark, df).first()
    assert (row.doc_id, row.n_bytes, bytes(row.kept)) == (1, 300, b"")
