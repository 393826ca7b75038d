import hashlib
import random
import re

from twinfold.llm import decontaminate as dc


def words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    out = []
    windows = []
    for item_id, text in items:
        w = words(text)
        k = min(10, len(w))
        windows += [(item_id, w[i:i + k]) for i in range(len(w) - k + 1) if k]
    for d, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit |= set(range(i, i + len(win)))
                    ids |= {item_id} - {None}
        sha = hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()
        out.append((d, len(w), len(hit), len(ids), sha, bool(hit)))
    return sorted(out, key=str)


def got(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    return sorted((tuple(r) for r in dc.digest(dc.contamination(spark, d, i, **kw)).collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(40)] + ["é", "Ünd", "The", "ß1"]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([1, 2, 4, 5, 9, 10, 11, 25, 40]))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "!!"), (3, items[3][1]), (200, items[5][1]), (None, items[7][1])]
    docs = [(0, None), (1, ""), (2, "..."), (3, "x " * 3000)]
    for d in range(10, 90):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            w = words(rng.choice(items)[1])
            at = rng.randint(0, max(0, len(w) - 12))
            parts += [" ".join(w[at:at + rng.randint(8, 20)]).upper(), text(rng.randint(0, 9))]
        docs.append((d, " ".join(parts)))
    return docs + [(10, docs[5][1]), (None, docs[6][1])], items


def test_matches_brute_force(spark):
    docs, items = corpus(1)
    assert got(spark, docs, items) == brute(docs, items)


def test_item_blocks_give_the_same_rows(spark):
    docs, items = corpus(2)
    assert got(spark, docs, items, block_bytes=1500) == brute(docs, items)


def test_spans_merge_across_blocks(spark):
    docs, items = corpus(3)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted(map(str, dc.contamination(spark, d, i, block_bytes=b).collect())) for b in (1 << 20, 1000))
    assert one == many


def test_empty_tables_and_clashing_columns(spark):
    docs, items = corpus(4)
    assert got(spark, [], items) == []
    assert got(spark, docs, []) == brute(docs, [])
    d = spark.createDataFrame([(1, "a b c", 7, "keep")], "doc_id long, text string, n_words int, c0 string")
    i = spark.createDataFrame([(5, "b c")], "item_id long, text string")
    row = dc.contamination(spark, d, i).first().asDict(recursive=True)
    assert row == {"doc_id": 1, "text": "a b c", "c0": "keep", "n_words": 3,
                   "hit_spans": [{"start": 1, "stop": 3}], "hit_items": [5]}
