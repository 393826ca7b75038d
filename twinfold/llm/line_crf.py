"""Document quality from a linear-chain conditional random field over lines.

Every non-blank line is good or bad. A line is described by its own shape (letters, capitals, symbols, word
lengths, repetition) and by the same figures of the line before and after it; a 2 x 2 transition table ties
neighbouring lines together. The field is trained on documents with a quality label (all lines of a labelled
document carry its label) by gradient ascent on the penalised conditional log-likelihood. A document's score is the
mean of its lines' forward-backward marginals P(good), weighted by line length.

Training uses at most ``max_docs`` labelled documents (those of smallest hash) of at most ``max_lines`` lines each;
their line figures, not their texts, go to the driver. Scoring runs in one pass without a shuffle; lines of a
document never leave their row.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.textblocks import Block, RangeHash, map_text, text_blocks

MAX_DOCS = 4000
MAX_LINES = 500
THRESHOLD = 0.7

FIGURES = ("log_bytes", "log_words", "word_length", "letters", "capitals", "digits", "marks", "stops", "foreign",
           "capital_words", "shouted", "marked_words", "again", "distinct", "seen_line", "short_words", "long_words")

_HASH = RangeHash(701)


def _classes() -> np.ndarray:
    """Class of every byte: 0 blank, 1 lower-case letter or byte of a non-ASCII character, 2 capital, 3 digit,
    4 sentence mark, 5 other mark."""
    table = np.full(256, 5, np.int8)
    table[[32, 9, 10, 11, 12, 13]] = 0
    table[97:123] = 1
    table[128:] = 1
    table[65:91] = 2
    table[48:58] = 3
    table[[ord(c) for c in ".,;:?'\"()-"]] = 4
    return table


_CLASS = _classes()


class Lines(NamedTuple):
    row: np.ndarray
    weight: np.ndarray
    figures: np.ndarray


def line_figures(block: Block) -> Lines:
    """Figures of the non-blank lines of a block, in order."""
    data, offsets = block.data, block.offsets
    n = len(data)
    kind = _CLASS[data]
    # A line ends at a newline, at the end of its row or where the next row begins.
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    begin, end = ends[:-1], ends[1:]
    counts = [np.concatenate([[0], np.cumsum(kind == c, dtype=np.int64)]) for c in range(6)]
    blank, lower, upper, digit, stop, mark = (c[end] - c[begin] for c in counts)
    keep = blank < end - begin
    begin, end, lower, upper, digit, stop, mark = (x[keep] for x in (begin, end, lower, upper, digit, stop, mark))
    size = lower + upper + digit + stop + mark
    row = np.searchsorted(offsets, begin, side="right") - 1
    if not len(begin):
        return Lines(row, size.astype(float), np.empty((0, len(FIGURES))))
    inside = kind != 0
    edge = np.zeros(n + 1, bool)
    edge[begin] = True
    starts = np.flatnonzero(inside & (np.concatenate([[True], ~inside[:-1]]) | edge[:n]))
    stops = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    line = np.searchsorted(begin, starts, side="right") - 1
    words = np.bincount(line, minlength=len(begin))
    length = stops - starts
    of = lambda c: counts[c][stops] - counts[c][starts]
    w_lower, w_upper, w_mark = of(1), of(2), of(5)
    prefix = _HASH.prefix(data)
    hashed = _HASH.ranges(prefix, starts, stops)
    per_line = lambda flag: np.bincount(line, weights=flag, minlength=len(begin)) / np.maximum(words, 1)
    again = np.zeros(len(starts), bool)
    again[1:] = (hashed[1:] == hashed[:-1]) & (line[1:] == line[:-1])
    order = np.lexsort((hashed, line))
    first = np.ones(len(starts), bool)
    first[1:] = (hashed[order][1:] != hashed[order][:-1]) | (line[order][1:] != line[order][:-1])
    distinct = np.bincount(line[order], weights=first, minlength=len(begin)) / np.maximum(words, 1)
    whole = _HASH.ranges(prefix, begin, stops[np.cumsum(words) - 1])
    by_line = np.lexsort((np.arange(len(begin)), whole, row))
    seen = np.zeros(len(begin), bool)
    seen[by_line[1:]] = ((whole[by_line][1:] == whole[by_line][:-1]) & (row[by_line][1:] == row[by_line][:-1]))
    high = np.concatenate([[0], np.cumsum(data >= 128, dtype=np.int64)])
    total = size.astype(float)
    figures = np.stack([
        np.log1p(size), np.log1p(words), np.minimum(size / words, 30) / 10, (lower + upper) / total, upper / total,
        digit / total, mark / total, stop / total, (high[end] - high[begin]) / total,
        per_line((w_upper > 0) & (w_lower > 0)), per_line((w_upper > 1) & (w_lower == 0)), per_line(w_mark > 0),
        per_line(again), distinct, seen.astype(float), per_line(length <= 3), per_line(length >= 10)], axis=1)
    return Lines(row, total, figures)


def _context(figures: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Own figures, those of the line before and after in the same row (zeros and a flag at the ends), and a constant."""
    n = len(row)
    same = np.zeros(n + 1, bool)
    same[1:n] = row[1:] == row[:-1]
    before = np.zeros_like(figures)
    after = np.zeros_like(figures)
    before[1:] = figures[:-1] * same[1:n, None]
    after[:-1] = figures[1:] * same[1:n, None]
    return np.concatenate([figures, before, after, ~same[:n, None], ~same[1:, None], np.ones((n, 1))], axis=1)


class Model(NamedTuple):
    """``weights``: log-odds of good per feature; ``switch``: scores of the transitions [from, to]; ``prior``: share of good."""

    center: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    switch: np.ndarray
    prior: float


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def marginals(odds: np.ndarray, switch: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over many chains at once.

    ``odds`` are the lines' log-odds of good, chain c owns lines ``first[c] .. first[c+1]-1`` (none empty). Returns
    P(good) per line, the expected transition counts (2 x 2) and the log-partition per chain.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    start, size = first[:-1][order], size[order]
    score = np.stack([np.zeros(len(odds)), odds], axis=1)
    forward, backward = score.copy(), np.zeros((len(odds), 2))
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), side="left")  # chains longer than t
    for t in range(1, longest):
        here = start[:active[t]] + t
        prev = forward[here - 1]
        forward[here] += _log_sum(prev[:, :1] + switch[0], prev[:, 1:] + switch[1])
    for t in range(longest - 2, -1, -1):
        here = start[:active[t + 1]] + t
        nxt = backward[here + 1] + score[here + 1]
        backward[here] = _log_sum(nxt[:, :1] + switch[:, 0], nxt[:, 1:] + switch[:, 1])
    last = start + size - 1
    log_z = np.empty(len(size))
    log_z[order] = _log_sum(forward[last, 0], forward[last, 1])
    z = np.repeat(log_z, np.diff(first))
    good = np.exp(np.minimum(forward[:, 1] + backward[:, 1] - z, 0.0))
    inner = np.ones(len(odds), bool)
    inner[first[:-1]] = False
    j = np.flatnonzero(inner)
    pair = np.exp(forward[j - 1][:, :, None] + switch[None] + (score[j] + backward[j])[:, None, :] - z[j][:, None, None])
    return good, pair.sum(0), log_z


def fit(figures: np.ndarray, row: np.ndarray, label: np.ndarray, rounds: int = 250, penalty: float = 1.0,
        rate: float = 0.1) -> Model:
    """Train on lines (grouped by ``row``, ascending) whose label is 0 or 1, by Adam on the whole sample."""
    prior = (float(label[np.concatenate([[True], row[1:] != row[:-1]])].mean()) if len(row) else 0.5)
    context = _context(figures, row)
    if not len(row) or label.min() == label.max():
        k = context.shape[1]
        return Model(np.zeros(k), np.ones(k), np.zeros(k), np.zeros((2, 2)), prior)
    center, scale = context.mean(0), context.std(0)
    center[-1], scale[scale < 1e-9] = 0.0, 1.0
    x = (context - center) / scale
    first = np.append(np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]])), len(row))
    inner = np.flatnonzero(np.concatenate([[False], row[1:] == row[:-1]]))
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[inner - 1], label[inner]), 1)
    params = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(params), np.zeros_like(params)
    docs = len(first) - 1
    for step in range(1, rounds + 1):
        good, pair, _ = marginals(x @ params[:-4], params[-4:].reshape(2, 2), first)
        ascent = np.concatenate([x.T @ (label - good), (seen - pair).ravel()]) - penalty * params
        ascent /= docs
        m = 0.9 * m + 0.1 * ascent
        v = 0.999 * v + 0.001 * ascent**2
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return Model(center, scale, params[:-4], params[-4:].reshape(2, 2), prior)


def scores(model: Model, lines: Lines, rows: int) -> np.ndarray:
    """Length-weighted mean marginal per row; rows without lines get the prior."""
    out = np.full(rows, model.prior)
    if len(lines.row):
        x = (_context(lines.figures, lines.row) - model.center) / model.scale
        first = np.append(np.flatnonzero(np.concatenate([[True], lines.row[1:] != lines.row[:-1]])), len(lines.row))
        good, _, _ = marginals(x @ model.weights, model.switch, first)
        total = np.bincount(lines.row, weights=lines.weight, minlength=rows)
        has = total > 0
        out[has] = np.bincount(lines.row, weights=lines.weight * good, minlength=rows)[has] / total[has]
    return np.clip(out, 0.0, 1.0)


def held_out(doc_id: Column) -> Column:
    """Documents that are never learnt from: crc32 of the doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "quality", max_docs: int = MAX_DOCS, max_lines: int = MAX_LINES, **fitting) -> Model:
    """The field trained on ``labels`` (0 or 1; other values and null ids are left out, of repeated ids the smallest
    label counts) of documents that are not held out. Without labels every score is 0.5."""
    known = (labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).cast("int").alias("label")))
    sample = known.orderBy(F.xxhash64("id"), "id").limit(max_docs)
    texts = (docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
             .join(F.broadcast(sample), "id").select("id", "text", "label"))  # at most max_docs rows of two integers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                lines = line_figures(b)
                cuts = np.searchsorted(lines.row, np.arange(b.rows + 1))
                for r in np.flatnonzero((np.diff(cuts) > 0) & (np.diff(cuts) <= max_lines)).tolist():
                    yield pa.record_batch([
                        batch.column(0).slice(b.first + r, 1), batch.column(2).slice(b.first + r, 1),
                        pa.array([lines.figures[cuts[r]:cuts[r + 1]].astype(np.float32).tobytes()], pa.binary())],
                        names=["id", "label", "figures"])

    kind = texts.schema["id"].dataType.simpleString()
    found = texts.mapInArrow(run, f"id {kind}, label int, figures binary")
    got = sorted(((r.id, bytes(r.figures), r.label) for r in found.groupBy("id").agg(
        F.min("figures").alias("figures"), F.min("label").alias("label")).collect()))
    parts = [np.frombuffer(f, np.float32).reshape(-1, len(FIGURES)) for _, f, _ in got]
    if not parts:
        return fit(np.empty((0, len(FIGURES))), np.empty(0, np.int64), np.empty(0, np.int64))
    size = [len(p) for p in parts]
    row = np.repeat(np.arange(len(parts)), size)
    label = np.repeat([label for _, _, label in got], size)
    return fit(np.concatenate(parts).astype(float), row, label, **fitting)


def score_documents(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1, higher is better), computed from the whole text.

    Null, empty and blank texts get the training share of good documents. Every row and column stays (a column
    ``score`` is replaced); equal texts have equal scores; an empty table gives an empty result.
    """
    plain = tuple(model)

    def run(block: Block) -> list:
        return [scores(Model(*plain), line_figures(block), block.rows)]

    return map_text(docs, text_col, [("score", T.DoubleType())], run)
