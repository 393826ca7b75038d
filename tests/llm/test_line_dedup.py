import random

from twinfold.llm import line_dedup as ld


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) < len(b):
        a, b = b, a
    return any(a[:i] + a[i + 1:] == b for i in range(len(a)))


def brute(rows, min_words=5):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    earlier, out = [], {}
    for i in order:
        d, text = rows[i]
        if text is None:
            out[i] = (d, None, 0, 0)
            continue
        keep = []
        for line in text.split("\n"):
            clean = line.strip(" \t\r\x0b\x0c")
            w = clean.split(" ")
            if clean == "":
                keep.append(line)
                continue
            if w not in earlier and not (len(w) >= min_words and any(distance_one(w, e) for e in earlier if len(e) >= min_words)):
                keep.append(line)
            earlier.append(w)
        out[i] = (d, "\n".join(keep), len(text.split("\n")), len(text.split("\n")) - len(keep))
    return sorted(out.values(), key=str)


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = ld.dedup_lines(spark, df, **kw).select("doc_id", "text", "n_lines", "n_removed")
    return sorted((tuple(r) for r in out.collect()), key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    vocab = ["the", "of", "é", "Ñandú", "a", "in"] + [f"w{i}" for i in range(25)]
    base = [[rng.choice(vocab) for _ in range(rng.choice([3, 4, 5, 6, 7, 8, 9, 15, 16, 17, 31, 32, 33, 40, 64]))] for _ in range(40)]
    base += [["x"] * k for k in (4, 5, 6, 20, 21)]

    def line():
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            p = rng.randrange(len(w) + 1)
            w[p:p + rng.choice([0, 1])] = [rng.choice(vocab)] * rng.choice([0, 1])
        return rng.choice(["", " ", "\t"]) + " ".join(w) + rng.choice(["", "\r", "  "])

    rows = [(d, "\n".join(line() for _ in range(rng.randint(1, 12)))) for d in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "  \t"), (n + 4, rows[3][1]), (n + 5, "a  b  c  d e\na b c d e")]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = corpus(seed)
        assert got(spark, rows) == brute(rows)


def test_short_lines_other_scripts_and_line_ends(spark):
    rows = [(1, "a b c d e\nLes.\n这是一个没有空格的很长的句子\nx\ty\n \t\nhttp://example.org/a"),
            (2, "a b X d e\r\n\tLes.\r\n这是一个没有空格的很长的句子\nx\ty \n\x0b\x0c\nLes\nhttp://example.org/a\f"), (3, "a b c d\na b c\na b c d")]
    assert got(spark, rows) == brute(rows)
    assert {r[0]: r[3] for r in got(spark, rows)} == {1: 0, 2: 5, 3: 1}


def test_shuffle_joins_give_the_same(spark):
    rows = corpus(3)
    assert got(spark, rows, max_broadcast=0) == brute(rows)


def test_repeated_and_null_ids(spark):
    rows = corpus(4, 20) + [(3, "one two three four five"), (3, "one two three four six"), (None, "one two three four five six"),
                            (None, "one two three four five six")]
    assert got(spark, rows) == brute(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(spark, []) == []
    df = spark.createDataFrame([(1, "a b c d e", 5, 6, "r", 0.5), (2, "a b c d e", 5, 6, "s", 1.5)],
                               "doc_id long, text string, row_id int, rank int, row string, n_lines double")
    rows = sorted(r.asDict().items() for r in ld.dedup_lines(spark, df).collect())
    assert [dict(r) for r in rows] == [
        {"doc_id": 1, "text": "a b c d e", "row_id": 5, "rank": 6, "row": "r", "n_lines": 1, "n_removed": 0},
        {"doc_id": 2, "text": "", "row_id": 5, "rank": 6, "row": "s", "n_lines": 1, "n_removed": 1}]


def test_plan_is_native(spark):
    rows = corpus(5, 10)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plan = ld.dedup_lines(spark, df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
