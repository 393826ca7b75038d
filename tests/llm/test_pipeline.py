import pytest

import corpus_pipeline as cp
from twinfold.llm import line_crf as lc
from twinfold.llm import mixing

from .test_decontaminate import brute as brute_hits
from .test_line_dedup import brute as brute_lines
from .test_mixing import water
from .test_simhash import brute_components

BASE = "/root/testdata/sf0.001"


def test_pipeline_matches_brute_force(spark):
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    labels = spark.read.parquet(f"{BASE}/labels.parquet")
    model = lc.train(spark, docs, labels)
    scores = {r.doc_id: r.score for r in lc.score_documents(docs, model).collect()}
    kept = [(d, rows[d].text) for d in sorted(rows) if scores[d] >= lc.THRESHOLD]
    kept = [(d, t) for d, t, *_ in brute_lines(kept)]
    first = {d for d, _, c in brute_components(kept) if c == d}
    kept = [(d, t) for d, t in kept if d in first]
    items = [tuple(r) for r in spark.read.parquet(f"{BASE}/benchmark.parquet").select("item_id", "text").collect()]
    clean = {d for d, *_, bad in brute_hits(kept, items) if not bad}
    kept = {d: t for d, t in kept if d in clean}
    got = cp.run(spark, BASE).collect()
    assert {r.doc_id for r in got} <= set(kept)
    sizes, taken = {}, {}
    for d, t in kept.items():
        sizes[rows[d].source] = sizes.get(rows[d].source, 0) + len(t.split())
    for r in got:
        assert r.text == kept[r.doc_id] and r.n_chars == len(r.text) and r.taken <= 2 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    want = water(sizes)
    assert all(abs(taken.get(s, 0) - want[s]) <= 1 for s in sizes)
    whole = mixing.mix(spark, spark.createDataFrame([(d, t, rows[d].source) for d, t in kept.items()], "doc_id long, text string, source string"))
    assert {r.doc_id: r.taken for r in whole.collect() if r.taken} == {r.doc_id: r.taken for r in got}


@pytest.mark.parametrize("stage", range(len(cp.STAGES)))
def test_stages_on_odd_tables(spark, stage):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_id int, score string"
    odd = [(1, None, None, None, None, 5, "a"), (1, None, None, None, None, 5, "a"), (None, "", "en", "s", 0, None, None),
           (2, "x " * 4000, "en", "s", 8000, 1, "b"), (3, "one two three four five six\n\nLes.", "fr", "t", 30, 1, "c"),
           (4, "one two three four five six\n\nLes.", "fr", "t", 30, 1, "c"), (None, "", "en", "s", 0, None, None)]
    name, fn = cp.STAGES[stage]
    for rows in (odd, []):
        docs = spark.createDataFrame(rows, schema)
        out = fn(spark, docs, BASE)
        if stage < len(cp.STAGES) - 1:
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        got = out.collect()
        assert len(got) <= len(rows)
        if stage == 2 and rows:
            # Texts without words have one fingerprint: of those four rows one stays, and one of the equal pair.
            assert len(got) == 3
