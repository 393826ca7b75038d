"""Benchmark decontamination as a prefix-filtered set join with exact window verification.

Words are the maximal runs of ``[0-9a-z]`` and non-ASCII characters of the A-Z-lowered text. A window is
10 consecutive words of an item (an item of fewer words, but not none, is one window); a document word
inside any occurrence of a window is hit.

A window is the set of its five-word shingles (fewer words: the window itself). An occurrence contains
all of them, so the overlap bound is the whole set and the necessary prefix is a single shingle: the rarest one
in the corpus. The plan is

1. count how often every item shingle occurs in the documents (one scan, counts combined in the task);
2. order each window's shingles by that count and keep the rarest, with its position in the window;
   a window with a shingle that never occurs cannot occur and goes;
3. scan the documents again: where a prefix shingle occurs, its position fixes where the window would have to
   begin and end; both ends must lie in the document (positional and length bound), the window's hash must
   agree, and then its words are compared byte by byte.

The item side is broadcast only in blocks of at most ``block_bytes`` bytes of text. A larger item table is cut
into several blocks that the documents pass one after the other in the same task; documents are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.textblocks import Block, RangeHash, lower_ascii, map_text, mix, split_words, text_blocks

WINDOW_WORDS = 10
SHINGLE_WORDS = 5
BLOCK_BYTES = 8 << 20

_IS_WORD = np.ones(256, bool)
_IS_WORD[:128] = False
_IS_WORD[48:58] = True
_IS_WORD[97:123] = True

_BYTES, _SEQUENCE = RangeHash(101), RangeHash(102)
_FILTER_BITS = 22


class _Hashed:
    """Words of a block and hashes of word ranges."""

    def __init__(self, block: Block):
        self.words = split_words(block._replace(data=lower_ascii(block.data)), _IS_WORD)
        prefix = _BYTES.prefix(self.words.data)
        self.prefix = _SEQUENCE.prefix(_BYTES.ranges(prefix, self.words.start, self.words.stop))
        self.row = np.repeat(np.arange(block.rows), np.diff(self.words.first))
        self.end = np.repeat(self.words.first[1:], np.diff(self.words.first))

    def shingles(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all shingles of k words inside one row."""
        at = np.arange(len(self.row))
        at = at[at + k <= self.end]
        # The length is mixed in, so shingles of different lengths never meet.
        return at, mix(_SEQUENCE.ranges(self.prefix, at, at + k) + np.uint64(k))


class _Lookup:
    """Membership of hashes in a sorted array, behind a bit table that turns nearly all of them away."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.unique(keys)
        self.table = np.zeros(1 << _FILTER_BITS, bool)
        self.table[self.keys >> np.uint64(64 - _FILTER_BITS)] = True

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``hashes`` that are keys, and which key."""
        maybe = np.flatnonzero(self.table[hashes >> np.uint64(64 - _FILTER_BITS)])
        if not len(maybe) or not len(self.keys):
            return maybe[:0], maybe[:0]
        spot = np.minimum(np.searchsorted(self.keys, hashes[maybe]), len(self.keys) - 1)
        same = self.keys[spot] == hashes[maybe]
        return maybe[same], spot[same]


class _Windows:
    """Distinct windows of a block of items, with their shingles."""

    def __init__(self, items: list[tuple], window_words: int, shingle_words: int):
        found: dict[bytes, set] = {}
        self.length, self.shingle, self.offset, self.window, self.size = [], [], [], [], []
        self.text: list[bytes] = []
        for item_id, text in items:
            for block in text_blocks(pa.array([text], pa.string())):
                h = _Hashed(block)
                n = len(h.row)
                if not n:
                    continue
                k = min(window_words, n)
                size = min(shingle_words, k)
                _, hashes = h.shingles(size)
                w = h.words
                joined = w.data.tobytes()
                for i in range(n - k + 1):
                    words = joined[w.start[i]:w.stop[i + k - 1]]
                    if words not in found:
                        found[words] = set()
                        for j in range(k - size + 1):
                            self.shingle.append(hashes[i + j])
                            self.offset.append(j)
                            self.window.append(len(self.text))
                            self.size.append(size)
                        self.text.append(words)
                        self.length.append(k)
                    if item_id is not None:
                        found[words].add(item_id)
        self.items = [sorted(found[t]) for t in self.text]
        self.shingle = np.array(self.shingle, np.uint64)
        self.offset, self.window, self.size, self.length = (
            np.array(x, np.int64) for x in (self.offset, self.window, self.size, self.length))

    def keep_rarest(self, counts: dict[int, int]) -> None:
        """One shingle per window: the rarest in the corpus (then the smallest hash); drop windows that cannot occur."""
        n = np.array([counts.get(int(s), 0) for s in self.shingle], np.int64)
        order = np.lexsort((self.offset, self.shingle, n, self.window))
        _, first = np.unique(self.window[order], return_index=True)
        absent = np.zeros(len(self.text), bool)
        absent[self.window[n == 0]] = True
        pick = order[first]
        pick = pick[~absent[self.window[pick]]]
        by_hash = np.argsort(self.shingle[pick], kind="stable")
        pick = pick[by_hash]
        self.shingle, self.offset, self.window, self.size = (
            x[pick] for x in (self.shingle, self.offset, self.window, self.size))


def _shingle_counts(docs: DataFrame, text_col: str, windows) -> dict[int, int]:
    """Occurrences in the documents of every item shingle of the block (at most as many rows as the block has shingles)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, size = windows.value["shingle"], windows.value["size"]
        lookups = {int(k): _Lookup(shingle[size == k]) for k in np.unique(size)}
        totals = {k: np.zeros(len(x.keys), np.int64) for k, x in lookups.items()}
        for batch in batches:
            for block in text_blocks(batch.column(0)):
                h = _Hashed(block)
                for k, lookup in lookups.items():
                    _, spot = lookup.find(h.shingles(k)[1])
                    totals[k] += np.bincount(spot, minlength=len(lookup.keys))
        for k, lookup in lookups.items():
            seen = np.flatnonzero(totals[k])
            yield pa.record_batch([pa.array(lookup.keys[seen].view(np.int64)), pa.array(totals[k][seen])],
                                  names=["shingle", "n"])

    rows = (docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "shingle long, n long")
            .groupBy("shingle").agg(F.sum("n").alias("n")).collect())
    return {r.shingle & ((1 << 64) - 1): r.n for r in rows}


def _find(h: _Hashed, block: Block, w: SimpleNamespace) -> tuple[np.ndarray, np.ndarray]:
    """Verified occurrences: first word and window."""
    begin, which = [], []
    joined = None
    for k in np.unique(w.size):
        mine = np.flatnonzero(w.size == k)
        lookup = _Lookup(w.shingle[mine])
        at, hashes = h.shingles(int(k))
        spot, key = lookup.find(hashes)
        if not len(spot):
            continue
        lo = np.searchsorted(w.shingle[mine], lookup.keys[key], side="left")
        n = np.searchsorted(w.shingle[mine], lookup.keys[key], side="right") - lo
        entry = mine[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        word = np.repeat(at[spot], n)
        first = word - w.offset[entry]
        row = h.row[word]
        fits = (first >= h.words.first[row]) & (first + w.length[w.window[entry]] <= h.words.first[row + 1])
        first, entry = first[fits], entry[fits]
        if joined is None:
            joined = h.words.data.tobytes()
        last = first + w.length[w.window[entry]] - 1
        same = np.array([joined[s:e] == w.text[x] for s, e, x in
                         zip(h.words.start[first].tolist(), h.words.stop[last].tolist(), w.window[entry].tolist())], bool)
        begin.append(first[same])
        which.append(w.window[entry][same])
    if not begin:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(begin), np.concatenate(which)


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())]))


def _mark(windows):
    def run(block: Block) -> list:
        w = SimpleNamespace(**windows.value)
        h = _Hashed(block)
        first, which = _find(h, block, w)
        n_words = np.diff(h.words.first)
        spans: list[list] = [[] for _ in range(block.rows)]
        items: list[list] = [[] for _ in range(block.rows)]
        if len(first):
            cover = np.zeros(len(h.row) + 1, np.int64)
            np.add.at(cover, first, 1)
            np.add.at(cover, first + w.length[which], -1)
            hit = np.concatenate([[False], np.cumsum(cover)[:-1] > 0, [False]])
            edge = h.words.first[h.words.first < len(h.row)]
            opens = hit[1:-1] & ~hit[:-2]
            opens[edge] |= hit[1:-1][edge]
            begins = np.flatnonzero(opens)
            ends = np.flatnonzero(hit[1:-1] & (~hit[2:] | np.isin(np.arange(1, len(h.row) + 1), edge))) + 1
            for b, e in zip(begins.tolist(), ends.tolist()):
                r = int(h.row[b])
                spans[r].append({"start": b - int(h.words.first[r]), "stop": e - int(h.words.first[r])})
            seen: dict[int, set] = {}
            for r, x in set(zip(h.row[first].tolist(), which.tolist())):
                seen.setdefault(r, set()).update(w.items[x])
            for r, ids in seen.items():
                items[r] = sorted(ids)
        return [n_words, spans, items]

    return run


def item_blocks(spark: SparkSession, items: DataFrame, id_col: str, text_col: str, window_words: int, shingle_words: int,
                block_bytes: int) -> Iterator[_Windows]:
    """Windows of the items, in blocks of about ``block_bytes`` bytes of text (a block is what one broadcast holds)."""
    narrow = items.select(F.col(id_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    for b in range(blocks):
        rows = narrow.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b).collect()
        yield _Windows([(r.item_id, r.text) for r in rows], window_words, shingle_words)


def contamination(spark: SparkSession, docs: DataFrame, items: DataFrame, text_col: str = "text",
                  item_id_col: str = "item_id", item_text_col: str = "text", window_words: int = WINDOW_WORDS,
                  shingle_words: int = SHINGLE_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with ``n_words``, ``hit_spans`` (maximal runs of hit words, word positions) and ``hit_items``.

    Every input row and column stays (these three names are replaced). Null and empty texts have no words. An
    empty item table, or items without words, hit nothing. Repeated items count once per item_id; an item
    with a null id marks words but is not listed.
    """
    id_type = items.schema[item_id_col].dataType
    out, own = docs, {"n_words", "hit_spans", "hit_items"}
    for number, windows in enumerate(item_blocks(spark, items, item_id_col, item_text_col, window_words,
                                                 shingle_words, block_bytes)):
        shared = spark.sparkContext.broadcast(vars(windows))
        windows.keep_rarest(_shingle_counts(docs, text_col, shared))
        shared.unpersist()
        names = [f"_{x}_{number}" for x in ("n", "s", "i")]
        out = map_text(out, text_col, list(zip(names, (T.LongType(), _SPANS, T.ArrayType(id_type)))),
                       _mark(spark.sparkContext.broadcast(vars(windows))))
    count = number + 1
    spans = F.col("_s_0")
    if count > 1:
        every = F.array_sort(F.concat(*[F.col(f"_s_{b}") for b in range(count)]))
        spans = F.aggregate(every, F.expr("CAST(array() AS array<struct<start:int,stop:int>>)"), _merge_span)
    ids = F.array_sort(F.array_distinct(F.concat(*[F.col(f"_i_{b}") for b in range(count)])))
    plain = [F.col(c) for c in docs.columns if c.lower() not in own]
    return out.select(*plain, F.col("_n_0").alias("n_words"), spans.alias("hit_spans"), ids.alias("hit_items"))


def _merge_span(done, span):
    """Append a span to sorted, merged spans; spans that overlap become one."""
    back = F.try_element_at(done, F.lit(-1))
    joined = F.struct(back["start"].alias("start"), F.greatest(back["stop"], span["stop"]).alias("stop"))
    return F.when((F.size(done) > 0) & (back["stop"] >= span["start"]),
                  F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined))
                  ).otherwise(F.concat(done, F.array(span)))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_hit, n_items, items_sha256, contaminated`` from ``contamination``'s columns."""
    n_hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    ids = F.array_sort(F.transform("hit_items", lambda i: i.cast("string")))
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"),
                        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
