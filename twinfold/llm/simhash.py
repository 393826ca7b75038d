"""SimHash near-duplicates: popcount embedding, grid range join, exact verification.

Fingerprint. Words are the runs of non-blank bytes of the A-Z-lowered text, shingles are four
words joined by a space (fewer words: the whole sequence). Every shingle occurrence votes with the
64 bits of its XXH64 (seed 42); a bit of the fingerprint is 1 if more than half of the votes set it.
A text without words has fingerprint zero.

Linking. A fingerprint is embedded as the bit counts of its 32 two-bit segments. The Manhattan
distance of two embeddings never exceeds the Hamming distance of the fingerprints, so fingerprints
at most ``max_bits`` apart lie within that radius. The segments are cut into consecutive ranges with
radii r that satisfy sum(r + 1) > max_bits: in at least one range the embeddings are within r. Radius 0
means the same grid cell, radius 1 the same cell or one count higher by one, so every fingerprint
is filed under its own cell and looked up in the cells one step above it. Pairs that meet in a cell are
verified by the exact Hamming distance.

Scale. Documents with equal fingerprints are one class before anything is joined. Of the pairs that hold
in a cell only a spanning forest leaves the task (linear in the cell's members), never the pairs
themselves. A cell with more than ``cell_rows`` rows is cut into blocks, and every pair of blocks becomes a
task of its own, so no task holds more than 2 * cell_rows rows and no comparison is skipped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.llm.components import components
from twinfold.llm.storage import cut
from twinfold.llm.textblocks import lower_ascii, split_words, text_blocks

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
CELL_ROWS = 4096
_PAIRS = 1 << 21
_NAMELESS = 1 << 62

_NOT_BLANK = np.ones(256, bool)
_NOT_BLANK[[32, 9, 10, 11, 12, 13]] = False


def _block_fingerprints(block, shingle_words: int) -> np.ndarray:
    words = split_words(block._replace(data=lower_ascii(block.data)), _NOT_BLANK)
    joined = words.data.tobytes()
    begin, end = words.start, words.stop
    counts = np.diff(words.first)
    out = np.zeros(block.rows, np.uint64)
    # Shingle i spans words i .. i+k-1; rows with fewer words have one shingle of all their words.
    n_shingles = np.where(counts >= shingle_words, counts - shingle_words + 1, np.minimum(counts, 1))
    head = np.repeat(words.first[:-1], n_shingles)
    row_begin = np.cumsum(n_shingles) - n_shingles
    index = head + np.arange(len(head)) - np.repeat(row_begin, n_shingles)
    last = np.minimum(index + shingle_words, np.repeat(words.first[1:], n_shingles)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in zip(begin[index].tolist(), end[last].tolist())),
                         np.uint64, len(index))
    piece = 1 << 14
    for r in np.flatnonzero(n_shingles):
        votes = np.zeros(64, np.int64)
        for at in range(row_begin[r], row_begin[r] + n_shingles[r], piece):
            part = hashes[at:min(at + piece, row_begin[r] + n_shingles[r])].astype(">u8").view(np.uint8)
            votes += np.unpackbits(part.reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[r] = int.from_bytes(np.packbits(votes * 2 > n_shingles[r]).tobytes(), "big")
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), one row per input row; null text is empty text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [_block_fingerprints(b, shingle_words) for b in text_blocks(batch.column(1))]
            fp = np.concatenate(parts).view(np.int64) if parts else np.empty(0, np.int64)
            yield pa.record_batch([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, fp long")


def _ranges(max_bits: int) -> list[tuple[int, int, int]]:
    """(first segment, last + 1, radius): radii 1 or 0 with sum(radius + 1) = max_bits + 1, cut evenly."""
    pieces = max_bits // 2 + 1
    radii = [1] * (pieces - 1) + [1 if max_bits % 2 else 0]
    cuts = [32 * i // pieces for i in range(pieces + 1)]
    return [(cuts[i], cuts[i + 1], radii[i]) for i in range(pieces)]


def _cells(classes: DataFrame, max_bits: int) -> DataFrame:
    """``part, cell, kind, fp, cid``: kind 0 files a fingerprint under its cell, kind 1 looks up a cell one step above."""
    plan = _ranges(max_bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1 << 14):
                piece = batch.slice(at, 1 << 14)
                fp = piece.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                cid = piece.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                x = fp.view(np.uint64)
                counts = x - ((x >> np.uint64(1)) & np.uint64(0x5555555555555555))
                part, cell, kind, row = [], [], [], []
                rows = np.arange(len(x))
                for p, (lo, hi, radius) in enumerate(plan):
                    mask = np.uint64(((1 << (2 * hi)) - 1) ^ ((1 << (2 * lo)) - 1))
                    own = counts & mask
                    found = [(own, 0, rows)]
                    for seg in range(lo, hi) if radius else ():
                        low = rows[((counts >> np.uint64(2 * seg)) & np.uint64(3)) < 2]
                        found.append((own[low] + np.uint64(1 << (2 * seg)), 1, low))
                    for c, k, r in found:
                        cell.append(c)
                        row.append(r)
                        kind.append(np.full(len(r), k, np.int32))
                        part.append(np.full(len(r), p, np.int32))
                row = np.concatenate(row)
                yield pa.record_batch([pa.array(np.concatenate(part)), pa.array(np.concatenate(cell).view(np.int64)),
                                       pa.array(np.concatenate(kind)), pa.array(fp[row]), pa.array(cid[row])],
                                      names=["part", "cell", "kind", "fp", "cid"])

    return classes.select("fp", "cid").mapInArrow(run, "part int, cell long, kind int, fp long, cid long")


def _forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, smallest node of its component) that connect what the links (u, v) connect."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[:len(u)], flat[len(u):]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _pairs_in_cells(max_bits: int):
    """Arrow function over rows sorted by (part, cell, ba, bb, kind): verified links as a forest per piece."""
    def links(group: np.ndarray, kind: np.ndarray, same: np.ndarray, fp: np.ndarray, cid: np.ndarray):
        change = np.flatnonzero(np.diff(group)) + 1
        begin = np.concatenate([[0], change])
        size = np.diff(np.concatenate([begin, [len(group)]]))
        run = np.repeat(np.arange(len(begin)), size)
        filed = np.bincount(run, weights=kind == 0, minlength=len(begin)).astype(np.int64)
        # Filed rows come first in their run: a looked-up row meets all of them, and in a block pair (i, i)
        # a filed row meets the filed rows after it. Block pairs i <> j hold i's filed rows as kind 0
        # and j's rows as kind 1.
        me = np.arange(len(group))
        low = np.where(kind == 0, me + 1, begin[run])
        high = begin[run] + filed[run]
        low = np.where((kind == 0) & ~same, high, low)
        n = np.maximum(high - low, 0)
        at = 0
        total = np.cumsum(n)
        while at < len(n):
            stop = max(int(np.searchsorted(total, (total[at - 1] if at else 0) + _PAIRS, side="right")), at + 1)
            k = n[at:stop]
            left = np.repeat(me[at:stop], k)
            right = np.repeat(low[at:stop], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
            near = np.bitwise_count((fp[left] ^ fp[right]).view(np.uint64)) <= max_bits
            near &= cid[left] != cid[right]
            if near.any():
                yield _forest(cid[left[near]], cid[right[near]])
            at = stop

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate([h, c]) for h, c in zip(held, cols)]
            group = _group_number(cols[:4])
            cut_at = int(np.searchsorted(group, group[-1])) if len(group) else 0
            held = [c[cut_at:] for c in cols]
            yield from emit([c[:cut_at] for c in cols], group[:cut_at])
        if held is not None:
            yield from emit(held, _group_number(held[:4]))

    def _group_number(keys):
        if not len(keys[0]):
            return np.empty(0, np.int64)
        new = np.zeros(len(keys[0]), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        return np.cumsum(new)

    def emit(cols, group):
        if not len(group):
            return
        part, cell, ba, bb, kind, fp, cid = cols
        us, vs = [], []
        for u, v in links(group, kind, ba == bb, fp, cid):
            us.append(u)
            vs.append(v)
        if us:
            u, v = _forest(np.concatenate(us), np.concatenate(vs))
            yield pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])

    return run


def links(spark: SparkSession, classes: DataFrame, max_bits: int = MAX_BITS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """``u, v``: links between classes (``fp, cid``, fingerprints distinct) whose union connects exactly the fingerprints
    that chains of at most ``max_bits`` differing bits connect."""
    cells = _cells(classes, max_bits)
    crowded = (cells.groupBy("part", "cell").agg(F.count("*").alias("n")).where(F.col("n") > cell_rows)
               .select("part", "cell", F.ceil(F.col("n") / cell_rows).cast("int").alias("blocks")))
    placed = cells.join(crowded, ["part", "cell"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    # Block pair (ba, bb): filed rows of block ba, looked-up rows of block bb; filed rows of the later
    # blocks also take part as looked-up rows, so that filed pairs across blocks are compared once.
    spots = F.expr("""
        CASE WHEN blocks = 1 THEN array(struct(0 AS ba, 0 AS bb, kind AS kind))
             WHEN kind = 0 THEN concat(
                 transform(sequence(0, blocks - 1), j -> struct(mine AS ba, j AS bb, 0 AS kind)),
                 transform(filter(sequence(0, blocks - 1), i -> i < mine), i -> struct(i AS ba, mine AS bb, 1 AS kind)))
             ELSE transform(sequence(0, blocks - 1), i -> struct(i AS ba, mine AS bb, 1 AS kind)) END""")
    rows = (placed.withColumn("mine", mine).withColumn("spot", F.explode(spots))
            .select("part", "cell", F.col("spot.ba").alias("ba"), F.col("spot.bb").alias("bb"),
                    F.col("spot.kind").alias("kind"), "fp", "cid"))
    met = (rows.repartition("part", "cell", "ba", "bb")
           .sortWithinPartitions("part", "cell", "ba", "bb", "kind")
           .mapInArrow(_pairs_in_cells(max_bits), "u long, v long"))
    return met


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle_words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
                    cell_rows: int = CELL_ROWS) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs``.

    ``component_id`` is the smallest doc_id that chains of fingerprints at most ``max_bits`` apart reach.
    Null and empty texts, and texts of blanks only, have fingerprint zero and are linked like any other.
    Repeated rows stay repeated. Rows with a null doc_id keep their fingerprint; their component is the smallest
    doc_id of their group, or null if the group has none. An empty table gives an empty result.
    """
    prints = cut(spark, fingerprints(docs, id_col, text_col, shingle_words), "simhash")
    classes = cut(spark, prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("cid")), "classes")
    # Fingerprints of rows without doc_id pass links on as well; they get numbers above every doc_id.
    nameless = cut(spark, prints.where("doc_id IS NULL").select("fp").distinct().join(classes, "fp", "left_anti"),
                   "nameless")
    every = classes.unionByName(nameless.select("fp", (F.lit(_NAMELESS) + F.monotonically_increasing_id()).alias("cid")))
    roots = components(spark, links(spark, every, max_bits, cell_rows))
    named = (every.join(roots, every.cid == roots.node, "left")
             .select("fp", F.coalesce("root", "cid").alias("component_id")))
    named = named.select("fp", F.when(F.col("component_id") < _NAMELESS, F.col("component_id")).alias("component_id"))
    return prints.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def hex_fingerprint(column: str = "fp"):
    """The fingerprint as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
