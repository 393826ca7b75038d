import collections
import math
import random
import re

import pytest

from twinfold.llm import url_templates as ut


def parse(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    return ("".join(c.lower() if c.isascii() else c for c in m[1]), m[2]) if m else ("", "")


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in ut.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(rows):
    """The tree with dictionaries: host -> templates, level by level."""
    count = collections.Counter(parse(u) for _, u in rows)
    paths = []
    for (h, p), n in count.items():
        segs = (p[1:] if p.startswith("/") else p).split("/") if p else []
        if len(segs) > ut.MAX_DEPTH:
            segs = segs[:ut.MAX_DEPTH - 1] + ["**"]
        v = rule(h, p)[1]
        paths.append({"h": h, "p": p, "n": n, "s": segs, "t": "", "q": "", "allow": n * (v == "allow"), "block": n * (v == "block")})
    shape = lambda s: re.sub("[0-9]+", "#", s)
    for level in range(max((len(x["s"]) for x in paths), default=0)):
        nodes = collections.defaultdict(list)
        for x in paths:
            if level < len(x["s"]):
                nodes[x["h"], x["t"]].append(x)
        for members in nodes.values():
            ok = lambda c: c >= ut.MIN_COUNT
            name, shapes = collections.Counter(), collections.Counter()
            for x in members:
                name[x["s"][level]] += x["n"]
            for s, c in name.items():
                if not ok(c):
                    shapes[shape(s)] += c
            branches = collections.defaultdict(list)
            for x in members:
                s = x["s"][level]
                x["tok"] = s if ok(name[s]) else shape(s) if ok(shapes[shape(s)]) else "*"
                x["plain"] = x["tok"]
                if ok(name[s]):
                    branches[s].append(x)
            pools = collections.defaultdict(list)
            for b in branches.values():
                a, k = sum(x["allow"] for x in b), sum(x["block"] for x in b)
                pools["none" if a + k == 0 else "block" if k > a else "allow"].append(b)
            for lean, group in pools.items():
                if len(group) < 2:
                    continue
                def shares(xs):
                    n = sum(x["n"] for x in xs)
                    lab = [sum(x["allow"] for x in xs) / n, sum(x["block"] for x in xs) / n]
                    nxt = collections.Counter()
                    for x in xs:
                        nxt[shape(x["s"][level + 1]) if level + 1 < len(x["s"]) else ""] += x["n"] / n
                    return n, lab + [1 - sum(lab)], nxt
                pn, pl, pf = shares([x for b in group for x in b])
                for b in group:
                    n, lab, nxt = shares(b)
                    bound = math.sqrt(.5 * math.log(2 / ut.ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(pn))
                    if sum(abs(x - y) for x, y in zip(lab, pl)) / 2 <= bound and sum(max(0, c - pf[f]) for f, c in nxt.items()) <= bound:
                        for x in b:
                            x["tok"] = "~" + lean
            for x in members:
                x["t"] += "/" + x["tok"]
                x["q"] += "/" + x["plain"]
    A, B = sum(x["allow"] for x in paths), sum(x["block"] for x in paths)
    smooth = lambda xs, back: (sum(x["block"] for x in xs) + ut.WEIGHT * back) / (
        sum(x["allow"] + x["block"] for x in xs) + ut.WEIGHT)
    by_q, by_t = collections.defaultdict(list), collections.defaultdict(list)
    for x in paths:
        by_q[x["q"]].append(x)
        by_t[x["h"], x["t"]].append(x)
    back = {q: min(.5, smooth(xs, B / (A + B) if A + B else 0.0)) for q, xs in by_q.items()}
    pure = {t: smooth(xs, sum(x["n"] * back[x["q"]] for x in xs) / sum(x["n"] for x in xs)) for t, xs in by_t.items()}
    info = {(x["h"], x["p"]): (x["t"], pure[x["h"], x["t"]]) for x in paths}
    out = []
    for i, u in rows:
        h, p = parse(u)
        r, v = rule(h, p)
        t, z = info[h, p]
        out.append((i, h, p, r, v or ("block" if z > .5 else "allow"), t, pytest.approx(z)))
    return out


def urls(seed, n=500):
    rng = random.Random(seed)
    hosts = ["a.example.net", "b.example.com", "C.example.ORG", "net", "example.net", "x.org", "big.example.com:80", "éA.example.com"]
    rows = []
    for i in range(n):
        h = rng.choices(hosts, [30, 10, 10, 3, 3, 5, 20, 2])[0]
        p = rng.choice(["/en/", "/de/", "/fr/", "/es/", "/", "", "/en", "/shop/item/"]) + rng.choice(
            [str(rng.randrange(999)), f"{rng.randrange(99)}.html", "index", "a/b/c/d/e/f/g/h/i/j", ""])
        rows.append((i, rng.choice(["http://", "HTTPS://"]) + h + p + rng.choice(["", "?q=/x", "#top", "?u=http://z.net/"])))
    return rows + [(n, None), (n + 1, ""), (n + 2, "no scheme"), (n + 3, "http://"), (n + 4, "x://?a"), (n + 5, "http://q.net"), (0, rows[0][1])]


def test_matches_brute_force(spark):
    for seed in (1, 2):
        rows = urls(seed)
        df = spark.createDataFrame(rows, "page_id long, url string")
        got = ut.judge_urls(spark, df).select("page_id", "host", "path", "rule", "verdict", "template", "purity").collect()
        key = lambda r: (r[0], r[2])
        assert sorted((tuple(r) for r in got), key=key) == sorted(brute(rows), key=key)


def test_clean_sections_beside_a_blocked_one_stay(spark):
    urls = [f"http://h.example.com/sec{i}/x/{j}" for i in range(60) for j in range(20)]
    bad = [f"http://h.example.com/de/x/{j}" for j in range(40)]
    df = spark.createDataFrame(list(enumerate(urls + bad)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in ut.judge_urls(spark, df).collect()}
    assert [got[i] for i in range(1240)] == ["allow"] * 1200 + ["block"] * 40


def test_other_hosts_never_reject_alone(spark):
    urls = [f"http://spam{i}.net/offer/{j}" for i in range(5) for j in range(20)]
    clean = [f"http://shop.example.org/offer/{j}" for j in range(20)] + ["http://x.example.org/offer/1"]
    mixed = ["http://y.example.com/de/7"] * 6 + [f"http://y.example.com/de{j}/{j}" for j in range(3)]
    df = spark.createDataFrame(list(enumerate(urls + clean + mixed)), "page_id long, url string")
    got = {r.page_id: r for r in ut.judge_urls(spark, df).collect()}
    assert all(got[100 + i].verdict == "allow" and got[100 + i].purity <= .5 for i in range(21))
    assert all(got[121 + i].verdict == "block" for i in range(6))


def test_unlabelled_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "http://a.b/c", "z"), (2, None, "y")], "page_id long, url string, host string")
    assert {r.verdict for r in ut.judge_urls(spark, df).collect()} == {"allow"}
    assert ut.judge_urls(spark, df.where("false")).collect() == []
