import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from twinfold.llm import token_pairs

A = Tokenizer.from_file(token_pairs.TOKENIZER_A)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=token_pairs.TOKENIZER_B)
LETTERS = {c: bytes([b]) for c, b in token_pairs._byte_letters().items()}


def spelled(text):
    """(ids, bytes) of both tokenizers over the whole text, without cutting it into words."""
    a = A.encode(" " + text, add_special_tokens=False).ids
    b = B.encode(text)
    a_bytes = [b"".join(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    b_bytes = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    return (a, a_bytes), (b, b_bytes)


def brute(texts):
    docs, counts = [], Counter()
    for text in texts:
        if not text:
            docs.append((0, 0, [], []))
            continue
        (a, a_bytes), (b, b_bytes) = spelled(text)
        if b"".join(a_bytes) != (" " + text).encode() or b"".join(b_bytes) != (" " + text).encode():
            docs.append((0, 0, [], []))
            continue
        ends_a, ends_b = np.cumsum([len(x) for x in a_bytes]), np.cumsum([len(x) for x in b_bytes])
        groups, links, last = [], [], (0, 0)
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = int(np.searchsorted(ends_a, end)) + 1, int(np.searchsorted(ends_b, end)) + 1
            groups.append(",".join(map(str, a[last[0]:i])) + "|" + ",".join(map(str, b[last[1]:j])))
            links.append((a[i - 1], b[j - 1]))
            last = (i, j)
        counts.update(links)
        docs.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    rows = [(na, nb, len(g), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", len(li),
             sum(counts[p] == most[p[1]] for p in li), sum(counts[p] for p in li)) for na, nb, g, li in docs]
    pairs = {p: (sum(p in d[3] for d in docs), n) for p, n in counts.items()}
    return rows, pairs


COLUMNS = ["n_a", "n_b", "n_groups", "groups_sha256", "n_links", "n_best", "count_sum"]
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b\n c\n  d \t e", "x▁y", "▁ x", "it's 10,000 <|endoftext|> <s> </s>", "été ½ ﬁ\u3000日本語 テスト",
       "\x00 \x1c a\x1c b", "\r\n\r\n  \n", "don't  'll 'x", "a" * 5000, "é " * 3000, " " * 700, "\u00a0 \u00a0x\u0085 y", "👩‍👩‍👧 z\u0301", "if x:\n    return  y"]


def noise(seed, n):
    rng = random.Random(seed)
    bits = ["the", "The", " ", "  ", "\n", "\t", ".", "é", "日本", "'s", "1234", "ing", "Ω", "🙂", "de", "__", "\u2003", "pre", "-"]
    return ["".join(rng.choices(bits, k=rng.randint(0, 60))) for _ in range(n)]


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3, "doc_id")
    docs, pairs = token_pairs.alignment(spark, df)
    return ([tuple(r[c] for c in COLUMNS) for r in docs.orderBy("doc_id").collect()],
            {(r.a_id, r.b_id): (r.docs, r.links) for r in pairs.collect()})


@pytest.mark.parametrize("chunk,block,words", [(4096, 1 << 20, 150_000), (7, 300, 20)])
def test_equals_whole_text_alignment(spark, monkeypatch, chunk, block, words):
    monkeypatch.setattr(token_pairs, "CHUNK_DOCS", chunk)
    monkeypatch.setattr(token_pairs, "BLOCK_BYTES", block)
    monkeypatch.setattr(token_pairs, "MAX_WORDS", words)
    texts = ODD + noise(1, 150) + ODD
    got, pairs = run(spark, texts)
    want, want_pairs = brute(texts)
    assert got == want
    assert pairs == want_pairs


def test_documents_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r.text for r in df.orderBy("doc_id").collect()]
    docs, pairs = token_pairs.alignment(spark, df)
    want, want_pairs = brute(texts)
    assert [tuple(r[c] for c in COLUMNS) for r in docs.orderBy("doc_id").collect()] == want
    assert {(r.a_id, r.b_id): (r.docs, r.links) for r in pairs.collect()} == want_pairs


def test_planes_return_every_count():
    rng = np.random.default_rng(3)
    key = np.unique(rng.integers(0, 40 * 4096, 3000))
    doc, pair, times = key % 4096, key // 4096 * 7, rng.integers(1, 2000, len(key))
    uniq, offsets, place, word = token_pairs.bitmaps(doc, pair, times)
    at, back, n = token_pairs.read_bits(place, word)
    of = uniq[np.searchsorted(offsets, at, side="right") - 1]
    got = Counter()
    for d, p, m in zip(back, of, n):
        got[(d, p)] += m
    assert got == Counter(dict(zip(zip(doc, pair), times)))


def test_null_and_repeated_ids_clashing_columns_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b", 1, 2), (1, "a b", 3, 4), (1, "a b", 5, 6), (None, None, 0, 0)],
                               "doc_id long, text string, chunk long, pair long")
    docs, _ = token_pairs.alignment(spark, df)
    rows = docs.collect()
    assert len(rows) == 4 and sorted(r.n_links for r in rows) == [0, 2, 2, 2]
    assert {r.count_sum for r in rows if r.n_links} == {6}
    docs, pairs = token_pairs.alignment(spark, df.limit(0))
    assert docs.count() == 0 and pairs.count() == 0
