import random

import pytest

from twinfold.llm import mixing


def water(sizes, share=1.5, weights=(3, 1, 2)):
    """Targets by the literal rule: share, stop at twice the size, reshare the excess."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total = share * sum(sizes.values())
    got, capped = {}, set()
    for _ in range(len(names) + 1):
        free = [s for s in names if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        got = {s: 2 * sizes[s] if s in capped else left * w[s] / sum(w[f] for f in free) for s in names}
        over = {s for s in free if got[s] > 2 * sizes[s]}
        if not over:
            break
        capped |= over
    return got


def run(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    return mixing.mix(spark, df, **kw).collect()


def docs(seed, n=400):
    rng = random.Random(seed)
    sources = ["a", "b", "é", "z", None, "tiny"]
    rows = [(i, " ".join(["w", "x!"][rng.random() < .2] for _ in range(rng.randint(0, 60))),
             rng.choices(sources, [30, 5, 10, 40, 3, 1])[0]) for i in range(n)]
    return rows + [(n, None, "a"), (n + 1, "", "empty"), (n + 2, " \n ", "empty")]


@pytest.mark.parametrize("seed,cells", [(1, 1024), (2, 1), (3, 7)])
def test_targets_and_taken_words(spark, monkeypatch, seed, cells):
    monkeypatch.setattr(mixing, "_MIN_CELLS", cells)
    rows = docs(seed)
    out = run(spark, rows)
    assert sorted(r.doc_id for r in out) == [r[0] for r in rows]
    sizes, taken = {}, {}
    for r in out:
        assert r.size == len((r.text or "").split()) and 0 <= r.taken <= 2 * r.size
        sizes[r.source] = sizes.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = water(sizes)
    for r in out:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source], abs=1e-6)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= 1
    # Whole epochs come first: within a source, documents differ by at most one epoch.
    for s in sizes:
        epochs = {r.taken // r.size for r in out if r.source == s and r.size}
        assert not epochs or max(epochs) - min(epochs) <= 1


def test_cells_do_not_change_the_choice(spark, monkeypatch):
    rows = docs(5)
    one = sorted((r.doc_id, r.taken) for r in run(spark, rows))
    monkeypatch.setattr(mixing, "_MIN_CELLS", 2)
    assert sorted((r.doc_id, r.taken) for r in run(spark, rows)) == one


def test_quality_weights_favour_clean_texts(spark):
    rows = [(i, "good words here now " * 5 if i % 2 else "b!#a$ d&s% " * 10, "s") for i in range(600)]
    rows += [(1000 + i, "other " * 20, "t") for i in range(3000)]
    taken = {0: 0, 1: 0}
    for r in run(spark, rows, share=0.5):
        if r.source == "s":
            taken[r.doc_id % 2] += r.taken
    assert taken[1] >= taken[0]


def test_repeated_rows_empty_table_and_clashing_columns(spark):
    rows = [(1, "a b c d e f g", "s")] * 5 + [(None, "x y", "s")] * 3 + [(2, "p q r", "t"), (3, "k " * 50, "u")]
    out = run(spark, rows)
    assert len(out) == len(rows) and all(r.taken <= 2 * r.size for r in out)
    same = {r.taken for r in out if r.doc_id == 1}
    assert len(same) == 1
    assert run(spark, []) == []
    df = spark.createDataFrame([(1, "a b", "s", 9, 9, "k")], "doc_id long, text string, source string, size int, row int, key string")
    r = mixing.mix(spark, df).first()
    assert (r.size, r.row, r.key, r.taken) == (2, 9, "k", 3)
