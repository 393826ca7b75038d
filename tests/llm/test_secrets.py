import hashlib
import random
import re

from twinfold.llm import secrets as sc


def brute(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?a:(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", text):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for i, (p, n) in enumerate(((r"AKIA[A-Z0-9]+", 16), (r"[0-9a-f]+", 32)), 1):
        out += [(m.start(), i, f"{('access', 'hex')[i - 1]}:{m.start()}:{m.end()}") for m in re.finditer(p, text) if len(m[0]) >= n]
    return [s for *_, s in sorted(out)]


def corpus(seed, n=150):
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    parts = [lambda: f'token = "{pick(hexa, 40)}"', lambda: f"PassWord:{pick(hexa, 6)}", lambda: f"api_key= {pick(upper, 20)}",
             lambda: "AKIA" + pick(upper, 16), lambda: "AKIA" + pick(upper, 4), lambda: pick(hexa, rng.choice([31, 32, 40, 64])),
             lambda: "ünd éa " + pick("etaoin", rng.randint(3, 24)), lambda: pick("etaoinshrdlu", rng.randint(10, 30)),
             lambda: "9" * rng.randint(10, 20), lambda: "toKen token=", lambda: "ſecret=12345678 Key"]
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(parts)() for _ in range(rng.randint(0, 12)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "é" * 50 + " secret: " + "x" * 5000), (3, rows[3][1])]


def test_base_spans_match_plain_patterns(spark):
    rows = corpus(1)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(sc.digest(sc.find_secrets(spark, df)).collect())
    want = sorted((d, *brute_row(t)) for d, t in rows)
    assert [tuple(r)[:5] for r in got] == want
    by_id = dict(rows)
    for r in got:
        base = [s for s in r.spans.split(",") if s and not s.startswith("like_")]
        assert base == brute(by_id[r.doc_id])


def brute_row(t):
    spans = brute(t)
    kinds = [s.split(":")[0] for s in spans]
    return (kinds.count("assign"), kinds.count("access"), kinds.count("hex"), hashlib.sha256(",".join(spans).encode()).hexdigest())


def test_automaton_recovers_a_format():
    rng = random.Random(2)
    hexa = "0123456789abcdef"
    strings = ["key-" + "".join(rng.choice(hexa) for _ in range(24)) for _ in range(400)]
    a = sc.infer([s.translate(sc._CLASSES) for s in strings])
    assert len(a.moves) < 60 and sum(a.ended) == 400
    words = ["".join(rng.choice("etaoinshrdlucm") for _ in range(28)) for _ in range(300)]
    like = lambda s: sc.log_likelihood(a, s.translate(sc._CLASSES))
    fresh = ["key-" + "".join(rng.choice(hexa) for _ in range(24)) for _ in range(100)]
    assert min(map(like, fresh)) > max(map(like, words))


def test_inferred_formats_add_spans_without_keywords(spark):
    rng = random.Random(3)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    words = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([4, 6, 18]))) for _ in range(20))
    make = lambda: "-".join("".join(rng.choice(upper) for _ in range(5)) for _ in range(4))
    rows = [(i, f"{words()} secret = {make()} {words()}") for i in range(200)] + [(1000 + i, f"{words()} {make()} {words()}") for i in range(30)]
    rows += [(2000 + i, words()) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sc.digest(sc.find_secrets(spark, df)).collect()}
    assert sum("like_assign" in got[1000 + i] for i in range(30)) >= 24
    assert sum("like_" in got[2000 + i] for i in range(100)) <= 1


def test_unlabelled_secrets_may_be_most_of_the_tokens(spark):
    rng = random.Random(4)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    make = lambda: "-".join("".join(rng.choice(upper) for _ in range(5)) for _ in range(4))
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(18))
    for share in (0.3, 0.8):
        rows = [(i, f"secret = {make()}") for i in range(200)]
        rows += [(1000 + i, make()) if i < 600 * share else (2000 + i, word()) for i in range(600)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: r.spans for r in sc.digest(sc.find_secrets(spark, df)).collect()}
        planted = [d for d in got if 1000 <= d < 2000]
        assert sum("like_assign" in got[d] for d in planted) >= 0.85 * len(planted)
        assert sum("like_" in got[d] for d in got if d >= 2000) <= 2


def test_short_secrets_are_scored(spark):
    rng = random.Random(5)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda k: "".join(rng.choice(upper) for _ in range(k))
    make = lambda: f"{pick(4)}-{pick(4)}-{pick(1)}"
    words = lambda: " ".join("".join(rng.choice("etaoinshrdlu") for _ in range(rng.choice([4, 9, 12]))) for _ in range(10))
    rows = [(i, f"{words()} secret = {make()} {words()}") for i in range(200)] + [(1000 + i, f"{words()} {make()}") for i in range(40)]
    rows += [(2000 + i, words()) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.spans for r in sc.digest(sc.find_secrets(spark, df)).collect()}
    assert sum("like_assign" in got[1000 + i] for i in range(40)) >= 34
    assert sum("like_" in got[2000 + i] for i in range(100)) <= 1


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, 5), (2, "plain words", 6)], "doc_id long, text string, secrets int")
    rows = sc.find_secrets(spark, df).collect()
    assert [r.secrets for r in rows] == [[], []]
    assert sc.find_secrets(spark, df.where("false")).collect() == []


def test_automaton_keeps_length_and_marks():
    rng = random.Random(6)
    pick = lambda k: "".join(rng.choice("0123456789abcdef") for _ in range(k))
    make = lambda: "-".join(pick(k) for k in (8, 4, 4, 4, 12))
    a = sc.infer([make().translate(sc._CLASSES) for _ in range(600)])
    like = lambda s: sc.log_likelihood(a, s.translate(sc._CLASSES))
    assert len(a.moves) == 37 and sum(a.ended) == 600
    assert all(sum(n for n, _ in a.moves[s].values()) + a.ended[s] == a.arrived[s] for s in range(37))
    right = min(like(make()) for _ in range(100))
    # Shorter strings have fewer factors; they are unlikelier all the same.
    assert all(right > like(s) for s in (make()[:-1], make().replace("-", ""), make() + "a"))


def test_merges_follow_the_test_between_states():
    # After a: 40 b of 40; after c: 40 d of 40. Too different to merge, so no string crosses over.
    apart = sc.infer(["ab"] * 40 + ["cd"] * 40)
    assert len(apart.moves) == 4 and apart.moves[apart.moves[0]["a"][1]].keys() == {"b"}
    # After a and after c the same: merged, and so are the states behind.
    alike = sc.infer(["ab", "ad", "cb", "cd"] * 20)
    assert len(alike.moves) == 3 and alike.moves[0]["a"][1] == alike.moves[0]["c"][1] and alike.arrived == [80, 80, 80]


def test_mixed_formats_and_plain_words():
    rng = random.Random(7)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    hexa, upper, low = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "etaoinshrdlucmwfgypbvk"
    kinds = [lambda: pick(hexa, 40), lambda: "sk_" + pick(upper + low, 24), lambda: pick(upper + low + "+/", rng.randint(8, 20))]
    word = lambda: pick(low, rng.randint(8, 20))
    classes = lambda s: s.translate(sc._CLASSES)
    formats = sc.fit({"assign": [classes(rng.choice(kinds)()) for _ in range(600)]},
                     [classes(word() if rng.random() < .8 else rng.choice(kinds)()) for _ in range(600)])
    found = lambda make: sum(sc.score_classes(formats, classes(make()))[0] is not None for _ in range(200))
    assert all(found(make) >= 160 for make in kinds) and found(word) <= 2
