"""Secret scan: three fixed patterns, and formats inferred from what they find.

The patterns label credentials. For each kind a prefix tree of the labelled credentials (characters reduced to
classes) is folded into a probabilistic automaton: two states are merged when a Hoeffding test finds no difference between
their end and transition frequencies, nor between those of the states below them. A second automaton is learnt the same way from
ordinary tokens. Every other token of at least as many credential characters as a format's shortest secret is scored by the log-likelihood ratio
of each format against the ordinary one; it becomes a span ``like_<kind>`` if the ratio is positive and above what the lowest
hundredth of the labelled credentials reach. However many tokens pass, all are reported. As tokens without a keyword may
be credentials too, the ordinary automaton starts empty (every string as likely as its length) and is learnt again from the
sampled tokens that do not pass until these stay the same (at most ``ROUNDS`` times); the bar is the lowest twentieth until then.

Learning uses at most ``max_samples`` distinct tokens of at most ``MAX_TOKEN`` characters per kind (those of smallest
hash); the automata, a few kilobytes, go to every task. Scoring reads every whole text in one pass without a shuffle.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import math
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.storage import cut
from twinfold.llm.textblocks import Block, map_text, text_blocks

#: Kinds in order, patterns, and the shortest secret of each.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile("AKIA[A-Z0-9]+")
HEX = re.compile("[0-9a-f]+")
SHORTEST = {"assign": 8, "access": 16, "hex": 32}

MAX_SAMPLES = 600
MAX_TOKEN = 256
ALPHA = 0.05
#: Share of a kind's labelled credentials that may score below its bar.
MISSED = 0.01
#: The same share while the ordinary automaton is being learnt.
MISSED_AT_FIRST = 0.05
#: How often the ordinary automaton is learnt at most.
ROUNDS = 10


def _byte_table(chars: str) -> np.ndarray:
    table = np.zeros(256, bool)
    table[[ord(c) for c in chars]] = True
    return table


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_TOKEN = _byte_table(_DIGITS + _LOWER + _UPPER + "+/_.=-")
_HEX = _byte_table(_DIGITS + "abcdef")
#: Class of a character: digit, a-f, g-z, A-F, G-Z; each mark is its own.
_CLASSES = str.maketrans({**dict.fromkeys(_DIGITS, "0"), **dict.fromkeys("abcdef", "h"), **dict.fromkeys("ghijklmnopqrstuvwxyz", "l"),
                          **dict.fromkeys("ABCDEF", "H"), **dict.fromkeys("GHIJKLMNOPQRSTUVWXYZ", "U")})


class Found(NamedTuple):
    kind: str
    start: int
    end: int
    token: str


def base_spans(text: str) -> list[Found]:
    """Matches of the fixed patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [Found("assign", m.start(), m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= SHORTEST["assign"]]
    if "AKIA" in text:
        out += [Found("access", m.start(), m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= SHORTEST["access"]]
    out += [Found("hex", m.start(), m.end(), m[0]) for m in HEX.finditer(text) if len(m[0]) >= SHORTEST["hex"]]
    return sorted(out, key=lambda f: (f.start, KINDS.index(f.kind)))


def _runs(table: np.ndarray, data: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, stop) of the maximal runs of at least ``least`` bytes of a table inside the rows."""
    inside = table[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    if not len(data):
        return (np.empty(0, np.int64),) * 3
    start = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | first[:-1]))
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | first[1:])) + 1
    long = stop - start >= least
    start, stop = start[long], stop[long]
    return np.searchsorted(offsets, start, side="right") - 1, start, stop


def _rows_with_base(block: Block) -> np.ndarray:
    """Rows in which a fixed pattern can match."""
    can = np.zeros(block.rows, bool)
    for mark in (58, 61):
        can[np.searchsorted(block.offsets, np.flatnonzero(block.data == mark), side="right") - 1] = True
    can[_runs(_HEX, block.data, block.offsets, SHORTEST["hex"])[0]] = True
    if b"AKIA" in block.data.tobytes():
        can[:] = True
    return can


def _scan(block: Block) -> tuple[dict[int, list[Found]], list[tuple[int, int, int, str]]]:
    """Base spans per row, and the other tokens as (row, start, end, token); positions in code points."""
    base: dict[int, list[Found]] = {}
    rest = []
    rows, starts, stops = _runs(_TOKEN, block.data, block.offsets, min(SHORTEST.values()))
    points = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80, dtype=np.int64)])
    raw = block.data.tobytes()
    for r in np.flatnonzero(_rows_with_base(block)).tolist():
        found = base_spans(raw[block.offsets[r]:block.offsets[r + 1]].decode())
        if found:
            base[r] = found
    # Per row the starts of its base spans, and how far those up to each reach.
    reach = {r: ([f.start for f in found], list(itertools.accumulate((f.end for f in found), max))) for r, found in base.items()}
    for r, s, e in zip(rows.tolist(), starts.tolist(), stops.tolist()):
        a, b = (int(points[x] - points[block.offsets[r]]) for x in (s, e))
        begun = bisect.bisect_left(reach[r][0], b) if r in reach else 0
        if not begun or reach[r][1][begun - 1] <= a:
            rest.append((r, a, b, raw[s:e].decode()))
    return base, rest


class Automaton(NamedTuple):
    """Per state: how many strings arrived, how many ended, and ``{class: (count, next state)}``."""

    arrived: list[int]
    ended: list[int]
    moves: list[dict]


def prefix_tree(strings: list[str]) -> Automaton:
    arrived, ended, moves = [0], [0], [{}]
    for s in strings:
        state = 0
        arrived[0] += 1
        for c in s:
            if c not in moves[state]:
                moves[state][c] = (0, len(moves))
                arrived.append(0)
                ended.append(0)
                moves.append({})
            n, to = moves[state][c]
            moves[state][c] = (n + 1, to)
            state = to
            arrived[state] += 1
        ended[state] += 1
    return Automaton(arrived, ended, moves)


def infer(strings: list[str], alpha: float = ALPHA) -> Automaton:
    """The prefix tree of the strings with statistically compatible states of one depth merged, nearest to the root first.

    Merging within a depth pools the counts of a level before the next one is tested, so a format's length, its marks and
    their places stay in the automaton; states of few strings are never compared with those of other depths.
    """
    a = prefix_tree(strings)
    factor = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return n1 > 0 and n2 > 0 and abs(f1 / n1 - f2 / n2) > factor * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(p: int, q: int) -> bool:
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            if differ(a.ended[p], a.arrived[p], a.ended[q], a.arrived[q]):
                return False
            for c in a.moves[p].keys() | a.moves[q].keys():
                (n1, t1), (n2, t2) = a.moves[p].get(c, (0, None)), a.moves[q].get(c, (0, None))
                if differ(n1, a.arrived[p], n2, a.arrived[q]):
                    return False
                if t1 is not None and t2 is not None:
                    stack.append((t1, t2))
        return True

    def merge(p: int, q: int, parent: int, c: str) -> None:
        """Point parent's move at p and fold the tree below q into p."""
        a.moves[parent][c] = (a.moves[parent][c][0], p)
        stack = [(p, q)]
        while stack:
            p, q = stack.pop()
            a.arrived[p] += a.arrived[q]
            a.ended[p] += a.ended[q]
            for s, (n, to) in a.moves[q].items():
                if s in a.moves[p]:
                    m, there = a.moves[p][s]
                    a.moves[p][s] = (m + n, there)
                    stack.append((there, to))
                else:
                    a.moves[p][s] = (n, to)

    red, level = [0], [0]
    while level:
        # Two parents share no child: what merging joined, it joined at a state and all that hangs from it.
        below: list[int] = []
        for parent in level:
            for c in sorted(a.moves[parent]):
                state = a.moves[parent][c][1]
                like = next((r for r in below if compatible(r, state)), None)
                if like is None:
                    below.append(state)
                else:
                    merge(like, state, parent, c)
        red += below
        level = below
    number = {s: i for i, s in enumerate(red)}
    return Automaton([a.arrived[s] for s in red], [a.ended[s] for s in red],
                     [{c: (n, number[to]) for c, (n, to) in a.moves[s].items()} for s in red])


_SYMBOLS = 11


def log_likelihood(a: Automaton, classes: str) -> float:
    """Log-probability of a string; unseen moves keep a little mass (and stay in their state)."""
    state, total = 0, 0.0
    for c in classes:
        n, to = a.moves[state].get(c, (0, state))
        total += math.log((n + 0.1) / (a.arrived[state] + 0.1 * (_SYMBOLS + 1)))
        state = to
    return total + math.log((a.ended[state] + 0.1) / (a.arrived[state] + 0.1 * (_SYMBOLS + 1)))


class Formats(NamedTuple):
    ordinary: Automaton
    by_kind: dict
    bars: dict


def score_classes(formats: Formats, classes: str) -> tuple[str | None, float]:
    """Best kind over its bar and its log-likelihood ratio; a format is asked from its shortest secret's length on."""
    plain = log_likelihood(formats.ordinary, classes)
    best: tuple[str | None, float] = (None, -math.inf)
    for kind, automaton in formats.by_kind.items():
        if len(classes) < SHORTEST[kind]:
            continue
        ratio = log_likelihood(automaton, classes) - plain
        if ratio > formats.bars[kind] and ratio > best[1]:
            best = (kind, ratio)
    return best


def learn(spark: SparkSession, docs: DataFrame, text_col: str = "text", max_samples: int = MAX_SAMPLES) -> Formats | None:
    """Automata for the kinds that occur; None if no credential or no ordinary token is found."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task keeps the max_samples tokens of smallest hash per kind.
        smallest: dict[str, dict[str, int]] = defaultdict(dict)
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                base, rest = _scan(block)
                pairs = {(f.kind, f.token) for fs in base.values() for f in fs} | {("ordinary", t) for *_, t in rest}
                for kind, token in pairs:
                    if len(token) <= MAX_TOKEN:
                        smallest[kind][token] = xxhash.xxh64_intdigest(token) >> 1
                for kind, held in smallest.items():
                    if len(held) > 4 * max_samples:
                        smallest[kind] = dict(heapq.nsmallest(max_samples, held.items(), key=lambda x: (x[1], x[0])))
        for kind, held in smallest.items():
            top = heapq.nsmallest(max_samples, held.items(), key=lambda x: (x[1], x[0]))
            yield pa.record_batch([pa.array([kind] * len(top)), pa.array([t for t, _ in top]), pa.array([h for _, h in top])],
                                  names=["kind", "token", "h"])

    tokens = cut(spark, docs.select(F.col(text_col).cast("string").alias("text"))
                 .mapInArrow(run, "kind string, token string, h long").distinct(), "tokens")
    sample = None
    for kind in (*KINDS, "ordinary"):
        part = tokens.where(F.col("kind") == kind).orderBy("h", "token").limit(max_samples)
        sample = part if sample is None else sample.unionByName(part)
    by_kind: dict = defaultdict(list)
    for r in sample.collect():
        by_kind[r.kind].append(r.token.translate(_CLASSES))
    if not by_kind.get("ordinary") or len(by_kind) < 2:
        return None
    return fit({k: by_kind[k] for k in KINDS if by_kind.get(k)}, by_kind["ordinary"])


def fit(labelled: dict[str, list[str]], other: list[str]) -> Formats:
    """Formats of the labelled credentials against the other tokens (all as classes) that none of the formats takes."""
    automata = {k: infer(sorted(strings)) for k, strings in labelled.items()}
    own = {k: [log_likelihood(a, s) for s in labelled[k]] for k, a in automata.items()}
    ordinary: list[str] = []

    def against(plain: Automaton, missed: float) -> Formats:
        bars = {k: max(0.0, float(np.quantile([x - log_likelihood(plain, s) for x, s in zip(own[k], labelled[k])], missed)))
                for k in automata}
        return Formats(plain, automata, bars)

    for _ in range(ROUNDS):
        plain = infer(ordinary)
        formats = against(plain, MISSED_AT_FIRST)
        left = [s for s in sorted(other) if score_classes(formats, s)[0] is None]
        if left == ordinary:
            break
        ordinary = left
    return against(plain, MISSED)


_SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
                                   T.StructField("end", T.IntegerType())]))


def find_secrets(spark: SparkSession, docs: DataFrame, text_col: str = "text", max_samples: int = MAX_SAMPLES) -> DataFrame:
    """``docs`` with ``secrets``: spans (kind, start, end; code points, end exclusive) by start, then kind.

    Kinds are those of the fixed patterns, then ``like_<kind>`` for inferred formats, which never overlap a base span.
    Null and empty texts have no spans; repeated rows repeat theirs; a column ``secrets`` is replaced; an empty table gives an
    empty result.
    """
    formats = learn(spark, docs, text_col, max_samples)
    plain = None if formats is None else (tuple(formats.ordinary), {k: tuple(a) for k, a in formats.by_kind.items()}, formats.bars)

    def run(block: Block) -> list:
        base, rest = _scan(block)
        spans: list[list] = [[] for _ in range(block.rows)]
        for r, found in base.items():
            spans[r] = [(f.start, KINDS.index(f.kind), f.kind, f.end) for f in found]
        if plain is not None:
            known = Formats(Automaton(*plain[0]), {k: Automaton(*a) for k, a in plain[1].items()}, plain[2])
            # Most tokens of a block share few class strings, each scored once.
            kinds: dict[str, str | None] = {}
            for r, start, end, token in rest:
                classes = token.translate(_CLASSES)
                if classes not in kinds:
                    kinds[classes] = score_classes(known, classes)[0]
                kind = kinds[classes]
                if kind:
                    spans[r].append((start, len(KINDS) + KINDS.index(kind), f"like_{kind}", end))
        return [[[{"kind": k, "start": s, "end": e} for s, _, k, e in sorted(row)] for row in spans]]

    return map_text(docs, text_col, [("secrets", _SPANS)], run)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` from ``find_secrets``'s column."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["kind"].isin(*KINDS))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("secrets")).alias("spans"))
