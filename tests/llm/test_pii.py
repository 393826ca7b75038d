import datetime
import hashlib
import random
import re

from twinfold.llm import pii

KEY = "test key"
PY = pii.PATTERNS


def digest(*parts):
    return hashlib.sha256("|".join(map(str, (KEY, *parts))).encode()).hexdigest()


def shift(text, stream):
    out = []
    for i, c in enumerate(text):
        v = int(stream[2 * (i % 32):2 * (i % 32) + 2], 16)
        for base, n in (("0", 10), ("a", 26), ("A", 26)):
            if ord(base) <= ord(c) < ord(base) + n:
                c = chr((ord(c) - ord(base) + v) % n + ord(base))
                break
        out.append(c)
    return "".join(out)


def text_permuted(s, kind):
    h = len(s) // 2
    left, right = s[:h], s[h:]
    for i in range(pii.ROUNDS):
        left, right = right, shift(left, digest(kind, len(left), i, right))
    return left + right


def number_permuted(x, parts, kind):
    a, b = divmod(x, parts[1])
    for i in range(pii.ROUNDS):
        a, b = b, (a + int(digest(kind, i, b)[:12], 16)) % parts[i % 2]
    return a * parts[1] + b


def luhn(body):
    total = 0
    for i, c in enumerate(reversed(re.sub("[^0-9]", "", body))):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


def laid(template, digits):
    rest = iter(digits)
    return "".join(next(rest) if c in "0123456789" else c for c in template)


def cards(m):
    """New text and pseudonyms of a run of digit groups."""
    spans = [g.span() for g in re.finditer("[0-9]+", m)]

    def best(i):
        found = []
        for j in range(i, len(spans)):
            d = re.sub("[^0-9]", "", m[spans[i][0]:spans[j][1]])
            if len(d) in pii.CARD_DIGITS and luhn(d[:-1]) == d[-1]:
                found.append((pii.CARD_DIGITS.index(len(d)), j, d))
        return min(found, default=None)

    out, listed, i, done = "", [], 0, 0
    while i < len(spans):
        b = best(i)
        if b and not (b[0] > 1 and any((best(k) or (9,))[0] <= 1 for k in range(i + 1, b[1] + 1))):
            body = text_permuted(b[2][:-1], "card")
            new = laid(m[spans[i][0]:spans[b[1]][1]], body + luhn(body))
            out += m[done:spans[i][0]] + new
            listed.append(("card", new))
            done, i = spans[b[1]][1], b[1]
        i += 1
    return out + m[done:], listed


def replaced(kind, m):
    if kind == "email":
        local, domain = m.split("@")
        return text_permuted(local, "email") + "@" + domain
    if kind == "phone":
        code = re.match(r"(\+[0-9]+[ -]?)?", m)[0]
        return code + laid(m[len(code):], text_permuted(re.sub("[^0-9]", "", m[len(code):]), "phone"))
    if kind == "ip":
        x = 0
        for o in m.split("."):
            x = x * 256 + int(o)
        x = number_permuted(x, pii.IP_PARTS, "ip")
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ssn":
        a, g, s = map(int, m.split("-"))
        if not (1 <= a <= 899 and a != 666 and g and s):
            return None
        x = number_permuted((a - (2 if a > 666 else 1)) * pii.SSN_PARTS[1] + (g - 1) * 9999 + s - 1, pii.SSN_PARTS, "ssn")
        a, rest = divmod(x, pii.SSN_PARTS[1])
        a += 1 + (a + 1 >= 666)
        return f"{a:03d}-{rest // 9999 + 1:02d}-{rest % 9999 + 1:04d}"
    form = {"-": "%Y-%m-%d", "/": "%d/%m/%Y", ".": "%d.%m.%Y"}[next(c for c in "-/." if c in m)]
    try:
        n = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
    except ValueError:
        return None
    if not 0 <= n < 73000:
        return None
    return (datetime.date(1900, 1, 1) + datetime.timedelta(number_permuted(n, pii.DATE_PARTS, "date"))).strftime(form)


def brute(text):
    if text is None:
        return None, []
    listed = []

    def one(m):
        kind = next(k for k in ("email", "ip", "ssn", "date", "phone", "card") if re.fullmatch(PY[k], m[0]))
        if kind == "card":
            text, some = cards(m[0])
            listed.extend(some)
            return text
        new = replaced(kind, m[0])
        if new is not None:
            listed.append((kind, new))
        return new if new is not None else m[0]

    return re.sub("|".join(PY.values()), one, text), listed


def card(rng, mark=""):
    body = "".join(rng.choice("0123456789") for _ in range(15))
    return mark.join((body + luhn(body))[i:i + 4] for i in range(0, 16, 4))


def corpus(seed, n=80):
    rng = random.Random(seed)
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    make = [lambda: card(rng), lambda: card(rng, "-"), lambda: card(rng, " "), lambda: num(16), lambda: num(12), lambda: num(25),
            lambda: f"{card(rng)} {num(2)}/{num(2)}", lambda: f"{num(1)} {card(rng, ' ')} {num(3)}",
            lambda: f"+1 ({num(3)}) 555-{num(4)}", lambda: f"{num(3)}-{num(3)}-{num(4)}", lambda: f"({num(3)}) {num(3)}-{num(4)}",
            lambda: ".".join(str(rng.randrange(300)) for _ in range(4)), lambda: f"{num(3)}-{num(2)}-{num(4)}",
            lambda: f"{rng.choice([1850, 1999, 2024, 2150])}-{rng.randrange(1, 14):02d}-{rng.randrange(1, 33):02d}",
            lambda: f"{rng.randrange(1, 33):02d}/{rng.randrange(1, 14):02d}/{rng.randrange(1900, 2099)}", lambda: "29.02.2023 29.02.2024",
            lambda: f"Jo.{num(2)}@mail{num(1)}.example.com", lambda: "a@b.c.", lambda: "x@y", lambda: "é wörd", lambda: "1.2.3.4.5"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(make)() for _ in range(rng.randint(0, 8)))) for i in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "no data here"), (n + 3, "a" * 100000 + " " + "1" * 50000), (3, rows[3][1])]


def got(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return [(r.doc_id, r.text, [tuple(p) for p in r.pii]) for r in pii.pseudonymise(df, KEY, **kw).collect()]


def test_matches_brute_force_and_goes_back(spark):
    rows = corpus(1)
    out = got(spark, rows)
    assert sorted(out, key=str) == sorted(((d, *brute(t)) for d, t in rows), key=str)
    back = got(spark, [(d, t) for d, t, _ in out], inverse=True)
    assert sorted(((d, t) for d, t, _ in back), key=str) == sorted(rows, key=str)


def test_equal_values_stay_linked_and_formats_hold(spark):
    rng = random.Random(2)
    cards = [card(rng) for _ in range(300)]
    out = got(spark, [(i, f"Card {c} at 10.0.0.{i % 256}, again {c}.") for i, c in enumerate(cards)])
    new = {}
    for (i, text, listed), c in zip(out, cards):
        found = re.findall(r"\d{16}", text)
        assert found[0] == found[1] != c and luhn(found[0][:-1]) == found[0][-1]
        assert [k for k, _ in listed] == ["card", "ip", "card"]
        new[c] = found[0]
    assert len(set(new.values())) == len(set(cards))


def test_cards_beside_other_numbers_and_in_other_spellings(spark):
    plain = "4111111111111111"
    texts = [plain, f"{plain} 12/25", "4111 1111 1111 1111 123", f"5 {plain}", "4111-1111-1111-1111", f"{plain} 5500000000000004",
             f"no. 17: {plain} 123 12/2027", f"{plain} 2024-05-06", f"{plain} 10.0.0.1", f"{plain} 555-123-4567", f"{plain} 12ab"]
    out = {t: (new, listed) for (_, new, listed), t in zip(sorted(got(spark, list(enumerate(texts)))), texts)}
    new = out[plain][0]
    assert new != plain and luhn(new[:-1]) == new[-1]
    spelt = [new[i:i + 4] for i in range(0, 16, 4)]
    assert out[f"{plain} 12/25"] == (f"{new} 12/25", [("card", new)])
    assert out["4111 1111 1111 1111 123"][0] == " ".join(spelt) + " 123"
    assert out[f"5 {plain}"][0] == f"5 {new}"
    assert out["4111-1111-1111-1111"][0] == "-".join(spelt)
    both = out[f"{plain} 5500000000000004"][1]
    assert [k for k, _ in both] == ["card", "card"] and both[0][1] == new
    assert out[f"no. 17: {plain} 123 12/2027"][0] == f"no. 17: {new} 123 12/2027"
    for other, kind in (("2024-05-06", "date"), ("10.0.0.1", "ip"), ("555-123-4567", "phone")):
        text, listed = out[f"{plain} {other}"]
        assert text.startswith(new + " ") and [k for k, _ in listed] == ["card", kind] and not text.endswith(other)
    assert out[f"{plain} 12ab"][0] == f"{new} 12ab"
    back = got(spark, [(i, out[t][0]) for i, t in enumerate(texts)], inverse=True)
    assert [t for _, t, _ in sorted(back)] == texts


def test_phone_numbers_in_other_spellings_stay_linked(spark):
    out = got(spark, [(0, "555-123-4567"), (1, "(555) 123-4567"), (2, "+1 555.123.4567")])
    digits = {re.sub("[^0-9]", "", t.removeprefix("+1 ")) for _, t, _ in out}
    assert len(digits) == 1 and digits != {"5551234567"}


def test_numbers_are_permuted_within_their_range(spark):
    from pyspark.sql import functions as F

    parts = (7, 30)
    df = spark.range(210).select("id", pii.feistel_number(F.col("id"), parts, "k", KEY).alias("x"))
    rows = df.select("id", "x", pii.feistel_number(F.col("x"), parts, "k", KEY, inverse=True).alias("y")).collect()
    assert sorted(r.x for r in rows) == list(range(210)) and all(r.y == r.id for r in rows)


def test_native_plan_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "call 555-123-4567", 3, "m")], "doc_id long, text string, pii int, m string")
    row = pii.pseudonymise(df, KEY).first()
    assert row.m == "m" and [p.kind for p in row.pii] == ["phone"] and row.text == brute("call 555-123-4567")[0]
    assert pii.pseudonymise(df.where("false"), KEY).collect() == []
    assert "Python" not in pii.pseudonymise(df, KEY)._jdf.queryExecution().toString()
