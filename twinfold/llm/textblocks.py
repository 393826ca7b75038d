"""Arrow text columns as byte blocks, and position hashes over them.

The text operators that run in Python read the UTF-8 bytes of an Arrow column in
place. A *block* is a run of whole rows of at most ``max_bytes`` bytes (one long
row is a block by itself), so the arrays made from it stay small whatever the
batch size. Null text counts as empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

BLOCK_BYTES = 1 << 19


class Block(NamedTuple):
    """Rows ``first .. first+len(offsets)-2`` of a batch; row r owns ``data[offsets[r]:offsets[r+1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    @property
    def rows(self) -> int:
        return len(self.offsets) - 1


def text_blocks(column: pa.Array, max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column (nulls read as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=kind)[column.offset:column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + max_bytes, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield Block(start, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start])
        start = stop


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


_GOLDEN = 0x9E3779B97F4A7C15
_WRAP = (1 << 64) - 1


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64 (multiply and xor-shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(_GOLDEN)
    return x ^ (x >> np.uint64(32))


class RangeHash:
    """Hash of any range of a sequence from prefix sums: sum of value * base^position, shifted back to position 0."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.table = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        base = int(rng.integers(0, 1 << 62)) * 8 + 5
        self._base, self._inverse = base & _WRAP, pow(base, -1, 1 << 64)
        self._pow = self._inv = np.empty(0, np.uint64)

    def _powers(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self._pow) < n:
            size = 1 << max(12, (n - 1).bit_length())
            for name, value in (("_pow", self._base), ("_inv", self._inverse)):
                steps = np.full(size, value, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self._pow, self._inv

    def prefix(self, values: np.ndarray) -> np.ndarray:
        """Prefix sums of a byte array (through the table) or a uint64 array (as it is)."""
        terms = self.table[values] if values.dtype == np.uint8 else values
        power, _ = self._powers(len(values) + 1)
        out = np.empty(len(values) + 1, np.uint64)
        out[0] = 0
        np.cumsum(terms * power[:len(values)], out=out[1:])
        return out

    def ranges(self, prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Mixed hashes of ``[start, stop)`` (equal contents, equal hash, wherever they are)."""
        _, inverse = self._powers(len(prefix))
        return mix((prefix[stop] - prefix[start]) * inverse[start])

    def grams(self, prefix: np.ndarray, k: int) -> np.ndarray:
        """Mixed hashes of every range of length k."""
        n = len(prefix) - k
        if n <= 0:
            return np.empty(0, np.uint64)
        _, inverse = self._powers(len(prefix))
        return mix((prefix[k:] - prefix[:n]) * inverse[:n])


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values (by doubling: log2(width) passes)."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


class Words(NamedTuple):
    """Words of a block, joined by single spaces within a row.

    ``data`` is the joined text of all rows (rows follow each other without a gap),
    word i is ``data[start[i]:stop[i]]``, row r owns words ``first[r] .. first[r+1]-1``.
    """

    data: np.ndarray
    start: np.ndarray
    stop: np.ndarray
    first: np.ndarray


def split_words(block: Block, is_word: np.ndarray) -> Words:
    """Maximal runs of word bytes of every row; ``is_word`` is a 256-entry table."""
    inside = is_word[block.data]
    n = len(inside)
    row_start = np.zeros(n + 1, bool)
    row_start[block.offsets] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | row_start[:n]))
    after = np.empty(n, bool)
    if n:
        after[-1] = False
        after[:-1] = inside[1:]
    stops = np.flatnonzero(inside & (~after | row_start[1:])) + 1
    first = np.searchsorted(starts, block.offsets)
    opens = np.zeros(len(starts), bool)
    opens[first[:-1][first[:-1] < first[1:]]] = True
    # Each word but the first of its row is preceded by one separator in the joined text.
    lengths = stops - starts
    shift = np.cumsum(lengths + ~opens) - lengths
    out = np.full(int(shift[-1] + lengths[-1]) if len(starts) else 0, 32, np.uint8)
    kept = np.flatnonzero(inside)
    out[kept + np.repeat(shift - starts, lengths)] = block.data[kept]
    return Words(out, shift, shift + lengths, first)


def map_text(docs: DataFrame, text_col: str, fields: list[tuple[str, T.DataType]],
             fn: Callable[[Block], list], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with one new column per field, computed from the text of each row (no shuffle).

    ``fn`` gets a block and returns one array (NumPy, Arrow or list) per field, one value per row. Every input
    column passes through, except that a new column replaces an input column of the same name.
    """
    names = docs.columns
    new = {name.lower() for name, _ in fields}
    kept = [i for i, name in enumerate(names) if name.lower() not in new or name.lower() == text_col.lower()]
    at = [n.lower() for n in names].index(text_col.lower())
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))]).withColumn("t", F.col(f"c{at}").cast("string"))
    carried = numbered.select("t", *[f"c{i}" for i in kept if i != at])
    schema = T.StructType(list(carried.schema.fields) + [T.StructField(f"n{i}", t) for i, (_, t) in enumerate(fields)])
    kinds = [to_arrow_type(t) for _, t in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fn(block) for block in text_blocks(batch.column(0), block_bytes)]
            extra = [pa.concat_arrays([_arrow(m[i], kind) for m in made]) if made else pa.array([], kind)
                     for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays(list(batch.columns) + extra, names=schema.names)

    out = carried.mapInArrow(run, schema)
    back = [F.col("t" if i == at else f"c{i}").alias(names[i]) for i in kept if names[i].lower() not in new]
    return out.select(*back, *[F.col(f"n{i}").alias(name) for i, (name, _) in enumerate(fields)])


def _arrow(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, kind)
