import itertools
import zlib

import numpy as np
import pyarrow as pa

from twinfold.llm import line_crf as lc
from twinfold.llm.textblocks import text_blocks


def test_marginals_match_enumeration():
    rng = np.random.default_rng(1)
    sizes = [1, 4, 2, 6, 1]
    first = np.concatenate([[0], np.cumsum(sizes)])
    odds, switch = rng.normal(size=sum(sizes)), rng.normal(size=(2, 2))
    good, pair, log_z = lc.marginals(odds, switch, first)
    want, pairs = [], np.zeros((2, 2))
    for c, n in enumerate(sizes):
        o = odds[first[c]:first[c + 1]]
        paths = list(itertools.product((0, 1), repeat=n))
        weight = np.array([np.exp(sum(x * s for x, s in zip(o, p)) + sum(switch[a, b] for a, b in zip(p, p[1:])))
                           for p in paths])
        assert np.isclose(np.log(weight.sum()), log_z[c])
        weight /= weight.sum()
        want += [sum(w for w, p in zip(weight, paths) if p[i]) for i in range(n)]
        for w, p in zip(weight, paths):
            for a, b in zip(p, p[1:]):
                pairs[a, b] += w
    assert np.allclose(good, want) and np.allclose(pair, pairs)


def test_line_figures_do_not_depend_on_blocks():
    texts = ["A line here\n\n  \nother LINE 12!!\nA line here", None, "", "\n", "word word word", "é ñ # # x"]
    column = pa.array(texts)
    whole = lc.line_figures(next(text_blocks(column)))
    parts = [(b.first, lc.line_figures(b)) for b in text_blocks(column, 5)]
    assert np.allclose(whole.figures, np.concatenate([p.figures for _, p in parts]))
    assert whole.row.tolist() == [r + f for f, p in parts for r in p.row.tolist()]
    assert whole.row.tolist() == [0, 0, 0, 4, 5]
    seen = lc.FIGURES.index("seen_line")
    assert whole.figures[:, seen].tolist() == [0, 0, 1, 0, 0]
    assert whole.figures[3, lc.FIGURES.index("again")] == 2 / 3


def test_neighbouring_lines_decide_alike():
    rng = np.random.default_rng(2)
    row = np.repeat(np.arange(300), 6)
    label = np.repeat(rng.integers(0, 2, 300), 6)
    figures = rng.normal(size=(1800, len(lc.FIGURES))) * 2
    figures[:, 0] += label
    model = lc.fit(figures, row, label)
    assert model.switch[0, 0] + model.switch[1, 1] > model.switch[0, 1] + model.switch[1, 0]
    score = lc.scores(model, lc.Lines(row, np.ones(1800), figures), 300)
    alone = ((figures[:, 0] > .5) == label).mean()
    assert ((score > .5) == label[::6]).mean() > alone + 0.05


def test_held_out_quality(spark):
    base = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    model = lc.train(spark, docs, labels)
    rows = lc.score_documents(docs.join(labels, "doc_id"), model).select("doc_id", "quality", "score").collect()
    test = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    good, bad = ([r.score for r in test if r.quality == q] for q in (1, 0))
    assert sum(g > b for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(s >= lc.THRESHOLD for s in good) / len(good) > 0.95
    assert sum(s < lc.THRESHOLD for s in bad) / len(bad) > 0.9


def test_labels_that_are_held_out_change_nothing(spark):
    base = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{base}/{t}.parquet") for t in ("documents", "labels"))
    import pyspark.sql.functions as F

    changed = labels.withColumn("quality", F.when(lc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = lc.train(spark, docs, labels), lc.train(spark, docs, changed)
    assert all(np.array_equal(a, b) for a, b in zip(one, two))


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "a", 3.0), (2, "", "b", 1.0), (3, " \n\t\n", "c", 1.0), (None, "x " * 9, None, 2.0),
                                (4, "same text", "d", 0.0), (4, "same text", "d", 0.0)],
                               "doc_id long, text string, c0 string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = lc.train(spark, df, none, max_docs=5)
    got = lc.score_documents(df, model).collect()
    assert len(got) == 6 and {r.score for r in got} == {0.5} and got[0].c0 == "a"
    odd = spark.createDataFrame([(4, 1), (4, 0), (1, None), (None, 1), (9, 7)], "doc_id long, quality int")
    model = lc.train(spark, df, odd)
    got = lc.score_documents(df, model).collect()
    assert all(0 <= r.score <= 1 for r in got) and got[4].score == got[5].score
    assert lc.score_documents(df.where("false"), model).collect() == []
