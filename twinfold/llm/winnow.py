"""Document fingerprints by winnowing.

The k-gram hashes of a text (k code points, 32 bits) are cut to one per window: of every ``window``
consecutive hashes the smallest is chosen, the rightmost if tied. Chosen hashes keep their positions (in code
points), so a passage of ``k + window - 1`` code points that two texts share is certain to give them a common
hash, and the positions say where. A text with fewer than ``window`` k-grams is one window; a non-empty text of
fewer than k code points has one hash, of the whole text; an empty or null text has none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from twinfold.llm.neighbours import with_next
from twinfold.llm.textblocks import Block, RangeHash, map_text, sliding_min, text_blocks

#: A shared passage of K + WINDOW - 1 = 27 code points is certain to give two texts a common hash.
K = 12
WINDOW = 16
_PIECE = 1 << 19
_SLOT_BITS = 20
_BYTES = RangeHash(301)


def select(block: Block, k: int = K, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, hash) of the chosen k-grams of a block, by row and position."""
    # Where each code point begins (the end of the data counts as one more beginning).
    begin = np.append(np.flatnonzero((block.data & 0xC0) != 0x80), len(block.data))
    first = np.searchsorted(begin, block.offsets)
    rows, places, hashes = [], [], []
    length = np.diff(first)
    short = np.flatnonzero((length > 0) & (length < k))
    if len(short):
        prefix = _BYTES.prefix(block.data)
        rows.append(short)
        places.append(np.zeros(len(short), np.int64))
        hashes.append(_BYTES.ranges(prefix, block.offsets[short], block.offsets[short + 1]) >> np.uint64(32))
    lo = 0
    total = len(begin) - 1
    mask = np.uint64((1 << _SLOT_BITS) - 1)
    while lo + k <= total:
        hi = min(lo + _PIECE + window + k - 2, total)
        part = block.data[begin[lo]:begin[hi]]
        local = begin[lo:hi + 1] - begin[lo]
        n = hi - lo - k + 1
        gram = _BYTES.ranges(_BYTES.prefix(part), local[:n], local[k:k + n]) >> np.uint64(32)
        row = np.searchsorted(first, np.arange(lo, lo + n), side="right") - 1
        inside = np.arange(lo, lo + n) + k <= first[row + 1]
        # Smaller hash first, then the larger slot (rightmost).
        keyed = (gram << np.uint64(_SLOT_BITS)) | (mask - np.arange(n, dtype=np.uint64))
        best = n and (mask - (sliding_min(keyed, min(window, n)) & mask)).astype(np.int64)
        at = np.arange(len(best))
        full = inside[at] & (at + lo + window + k - 1 <= first[row[at] + 1]) & (n >= window)
        chosen = np.unique(best[full])
        rows.append(row[chosen])
        places.append(chosen + lo - first[row[chosen]])
        hashes.append(gram[chosen])
        # Rows with at least one k-gram but no full window: their own minimum. They begin in one piece and end there.
        few = np.flatnonzero((length >= k) & (length < k + window - 1) & (first[:-1] >= lo) & (first[1:] <= hi)
                             & (first[:-1] < lo + _PIECE))
        if len(few):
            bounds = np.stack([first[few] - lo, first[few + 1] - lo - k + 1], axis=1).ravel()
            picked = np.minimum.reduceat(np.append(keyed, np.uint64(2**64 - 1)), bounds)[::2]
            slot = (mask - (picked & mask)).astype(np.int64)
            rows.append(few)
            places.append(slot - (first[few] - lo))
            hashes.append(gram[slot])
        lo += _PIECE
    if not rows:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    row, place, value = np.concatenate(rows), np.concatenate(places), np.concatenate(hashes)
    # A hash chosen by the last window of one piece may be chosen again by the first of the next.
    order = np.lexsort((place, row))
    row, place, value = row[order], place[order], value[order]
    keep = np.ones(len(row), bool)
    keep[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1])
    return row[keep], place[keep], value[keep]


def _split(block: Block, k: int, window: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Positions and hashes per row."""
    row, place, value = select(block, k, window)
    cuts = np.searchsorted(row, np.arange(1, block.rows))
    return np.split(place, cuts), np.split(value, cuts)


_MARKS = T.ArrayType(T.StructType([T.StructField("pos", T.LongType()), T.StructField("hash", T.LongType())]))


def fingerprints(docs: DataFrame, text_col: str = "text", k: int = K, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``fingerprint``: the chosen (pos, hash) pairs of every text, by position."""
    kind = pa.struct([("pos", pa.int64()), ("hash", pa.int64())])

    def run(block: Block) -> list:
        row, place, value = select(block, k, window)
        pairs = pa.StructArray.from_arrays([pa.array(place), pa.array(value.astype(np.int64))], fields=list(kind))
        return [pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(block.rows + 1)).astype(np.int32)), pairs)]

    return map_text(docs, text_col, [("fingerprint", _MARKS)], run)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes; two empty sets are alike."""
    x, y = set(a.tolist()), set(b.tolist())
    return len(x & y) / len(x | y) if x or y else 1.0


def _text(value: np.ndarray) -> str:
    """Chosen hashes by position, 8 hex digits each."""
    return value.astype(">u4").tobytes().hex()


def _block_of(texts: list[str]) -> Block:
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return Block(0, np.frombuffer(b"".join(raw), np.uint8), offsets)


_EDITED = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
    T.StructField("edited_sha256", T.StringType()), T.StructField("fingerprint", T.StringType()),
    T.StructField("edited_fingerprint", T.StringType()), T.StructField("near_edited", T.DoubleType()),
    T.StructField("near_next", T.DoubleType())])


def edited_neighbours(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K,
                      window: int = WINDOW, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Fingerprints of every text, of its edited text and their likeness to each other and to the next document.

    The edited text has the last third of the code points (rounded down) replaced by the first as many of the next
    document, in descending doc_id order (the last one's next is the first). Ties in doc_id are ordered by
    text, null ids come last. Documents meet their neighbour in one range-partitioned shuffle.
    """
    def run(texts: list[str], ids: list) -> pa.RecordBatch:
        """All but the last row of a stretch of neighbours."""
        own = _split(_block_of(texts), k, window)[1]
        changed = [t[:len(t) - len(t) // 3] + n[:len(t) // 3] for t, n in zip(texts, texts[1:])]
        new = _split(_block_of(changed), k, window)[1] if changed else []
        columns = [
            pa.array(ids[:-1], pa.int64()), pa.array([len(t) for t in texts[:-1]], pa.int64()),
            pa.array([hashlib.sha256(c.encode()).hexdigest() for c in changed]), pa.array([_text(f) for f in own[:-1]]),
            pa.array([_text(f) for f in new]), pa.array([likeness(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(own, own[1:])], pa.float64())]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, kinds)], names=_EDITED.names)

    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return with_next(docs, id_col, text_col, run, _EDITED, chunk_bytes)
