"""Removal of repeated byte strings: a depth-limited radix sort of suffixes.

Every byte covered by a string of ``threshold`` bytes that also starts anywhere else (same document
included) is removed; strings are judged on the input. Two suffixes repeat a string when they agree on
their first ``threshold`` bytes, so sorting suffixes to that depth is enough: groups that are still
together at depth ``threshold`` are exactly the repeated strings. The sort goes most significant digit
first, a pass drops every group of one, and a digit is a whole range of bytes, compared by hash:

1. *Anchors.* Not every suffix has to be sorted. Each string of ``threshold`` bytes is filed under one of its
   own ``gram``-byte pieces, the one with the smallest hash (leftmost if tied). Equal strings choose equal
   pieces at equal offsets, so only strings filed under equal pieces can be equal. An anchor is a piece
   together with all strings filed under it; they overlap, and there are about threshold/2 of them.
2. *First digit*: the piece. Pieces that occur once go (most of an ordinary corpus ends here).
3. *Second digit*: the whole range that the anchor's strings span. Anchors equal in it repeat all their
   strings at once. What is left are the rims of repeated passages.
4. *Last digit*: each rim anchor's strings one by one. They meet the strings of other rims of the same piece and of
   one representative per group of equal anchors; equal ones repeat.

Digits are compared by 64-bit hashes of the bytes, the later ones always together with the earlier
ones (the last digit by 128 bits).

Scale. Counts of the first digit combine in the tasks before the shuffle. Pieces that occur at most
``light`` times are sorted further in one more shuffle, group by group, in memory that ``light`` bounds. Pieces
that occur more often (at most ``heavy_list`` of them, the hottest, are found by a broadcast, the others by a join whose
keys are each below a ``heavy_list``-th of the heavy anchors) take the same digits by combined counts and joins; what is left of them is compared in memory too if
it has at most ``crowded`` different surroundings, and by further counts and joins if it has more, so no task
ever gathers them. Texts are moved compressed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.storage import broadcast_if_small, cut, number_rows
from twinfold.llm.textblocks import RangeHash, mix, sliding_min, text_blocks

THRESHOLD = 200
GRAM = 64
LIGHT = 500
HEAVY_LIST = 1_000_000
CROWDED = 4096
_PIECE = 1 << 19
_FIRST, _SECOND = RangeHash(201), RangeHash(202)
_SLOT_BITS = 20


def _anchors(data: np.ndarray, offsets: np.ndarray, threshold: int, gram: int):
    """Anchors of the rows of a block: (row, position of the anchor, first and last string start, gram hash, range hash).

    Positions are relative to the row. Long rows are taken in pieces of string starts; a piece's edge may split an
    anchor's strings over two anchors, which the later digits put together again.
    """
    out = []
    for lo in range(0, max(len(data) - threshold + 1, 0), _PIECE):
        part = data[lo:lo + _PIECE + threshold - 1]
        prefix = _FIRST.prefix(part)
        grams = _FIRST.grams(prefix, gram)
        slots = np.arange(len(grams), dtype=np.uint64)
        keyed = (grams & ~np.uint64((1 << _SLOT_BITS) - 1)) | slots
        best = (sliding_min(keyed, threshold - gram + 1) & np.uint64((1 << _SLOT_BITS) - 1)).astype(np.int64)
        starts = np.arange(len(best))
        row = np.searchsorted(offsets, starts + lo, side="right") - 1
        whole = starts + lo + threshold <= offsets[row + 1]
        starts, best, row = starts[whole], best[whole], row[whole]
        if not len(starts):
            continue
        new = np.flatnonzero(np.concatenate([[True], (np.diff(best) != 0) | (np.diff(row) != 0)]))
        last = np.concatenate([new[1:], [len(starts)]]) - 1
        spread = _FIRST.ranges(prefix, starts[new], starts[last] + threshold)
        base = offsets[row[new]] - lo
        out.append((row[new], best[new] - base, starts[new] - base, starts[last] - base, grams[best[new]], spread))
    if not out:
        return [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    return [np.concatenate(x) for x in zip(*out)]


def _anchor_rows(docs: DataFrame, threshold: int, gram: int, only_gram: bool = False) -> DataFrame:
    """``gram`` and, unless only the first digit is asked for, ``spread, row_id, at`` (anchor and offsets packed)."""
    names = ["gram"] if only_gram else ["gram", "spread", "row_id", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in text_blocks(batch.column(1)):
                row, at, first, last, gr, spread = _anchors(b.data, b.offsets, threshold, gram)
                cols = [pa.array(gr.view(np.int64))]
                if not only_gram:
                    ids = batch.column(0).take(pa.array(row + b.first))
                    # Offsets of the filed strings before the anchor are below the threshold.
                    packed = (at << 24) | ((at - first) << 12) | (at - last)
                    cols += [pa.array(spread.view(np.int64)), ids, pa.array(packed)]
                yield pa.record_batch(cols, names=names)

    return docs.select("row_id", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def _packed(docs: DataFrame) -> DataFrame:
    """``docs`` with the text as compressed bytes (``blob``) and its length, for a shuffle."""
    others = [c for c in docs.columns if c != "text"]
    schema = T.StructType([docs.schema[c] for c in others] + [T.StructField("n_bytes", T.LongType()),
                                                              T.StructField("blob", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd")
        for batch in batches:
            for b in text_blocks(batch.column(0)):
                blobs = [codec.compress(b.data[s:e], asbytes=True) for s, e in zip(b.offsets.tolist(), b.offsets[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [c.slice(b.first, b.rows) for c in batch.columns[1:]]
                    + [pa.array(np.diff(b.offsets)), pa.array(blobs, pa.binary())], names=schema.names)

    return docs.select("text", *others).mapInArrow(run, schema)


def _unpack(size: int, blob: bytes) -> np.ndarray:
    return np.frombuffer(pa.Codec("zstd").decompress(blob, size), np.uint8) if size else np.empty(0, np.uint8)


def _contexts(docs: DataFrame, listed: DataFrame, threshold: int) -> DataFrame:
    """The listed anchors with the bytes that their strings span from ``start``, ``lead`` bytes before the anchor."""
    per_row = listed.groupBy("row_id").agg(F.collect_list(F.struct("at", "gram", "rim", "heavy")).alias("listed"))
    names = ["gram", "heavy", "rim", "row_id", "start", "lead", "bytes"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                data = _unpack(batch.column(1)[r].as_py(), batch.column(2)[r].as_py())
                entries = batch.column(3)[r].values
                at = entries.field("at").to_numpy()
                first, last = (at >> 24) - ((at >> 12) & 4095), (at >> 24) - (at & 4095)
                cuts = [data[s:e].tobytes() for s, e in zip(first.tolist(), (last + threshold).tolist())]
                ids = pa.array(np.full(len(at), batch.column(0)[r].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([entries.field("gram"), entries.field("heavy"), entries.field("rim"), ids,
                                                  pa.array(first), pa.array((at >> 12) & 4095), pa.array(cuts, pa.binary())],
                                                 names=names)

    joined = _packed(docs.select("row_id", "text")).join(per_row, "row_id")
    return joined.select("row_id", "n_bytes", "blob", "listed").mapInArrow(
        run, "gram long, heavy boolean, rim boolean, row_id long, start long, lead long, bytes binary")


def _strings(column: pa.Array, threshold: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset in the row, two hashes) of every string of ``threshold`` bytes inside the rows of a binary column."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]]
    offsets = offsets - offsets[0]
    n = np.maximum(np.diff(offsets) - threshold + 1, 0)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    begin = offsets[row] + place
    hashes = [maker.ranges(maker.prefix(data), begin, begin + threshold) for maker in (_FIRST, _SECOND)]
    return row, place, *hashes


def _pieces(batch: pa.RecordBatch, size: int = 1 << 12) -> Iterator[pa.RecordBatch]:
    for lo in range(0, batch.num_rows, size):
        yield batch.slice(lo, size)


def _light_rims(contexts: DataFrame, threshold: int) -> DataFrame:
    """Repeated ranges of rim anchors whose pieces are light: groups meet in one task and are compared in memory."""
    def emit(table: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        row, place, h1, h2 = _strings(table.column("bytes"), threshold)
        _, which, count = np.unique(np.stack([h1, h2], axis=1), axis=0, return_inverse=True, return_counts=True)
        rim = table.column("rim").to_numpy(zero_copy_only=False).astype(bool)
        hit = np.flatnonzero((count[which.ravel()] > 1) & rim[row])
        if not len(hit):
            return
        # Strings that follow each other in one context are one range.
        opens = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(row[hit]) != 0)])
        begin = np.flatnonzero(opens)
        end = np.append(begin[1:], len(hit)) - 1
        start = table.column("start").to_numpy()[row[hit[begin]]]
        yield pa.record_batch([table.column("row_id").take(pa.array(row[hit[begin]])),
                               pa.array(start + place[hit[begin]]), pa.array(start + place[hit[end]] + threshold)],
                              names=["row_id", "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            for piece in _pieces(batch):
                if held is not None:
                    piece = pa.Table.from_batches([held, piece]).combine_chunks().to_batches()[0]
                gram = piece.column("gram").to_numpy()
                cut_at = int(np.searchsorted(gram, gram[-1]))
                held = piece.slice(cut_at)
                if cut_at:
                    yield from emit(piece.slice(0, cut_at))
        if held is not None:
            yield from emit(held)

    return (contexts.where("NOT heavy").select("gram", "rim", "row_id", "start", "bytes").repartition("gram")
            .sortWithinPartitions("gram").mapInArrow(run, "row_id long, start long, stop long"))


def _heavy_rims(spark: SparkSession, contexts: DataFrame, threshold: int) -> DataFrame:
    """The same for heavy pieces, by counts and joins across tasks.

    The last digit is refined in steps: strings are taken in blocks of neighbouring offsets from the anchor, of ever
    smaller size. What all strings of a block share is necessary for any of them to repeat: blocks alone in it go.
    What they span together is sufficient: blocks equal in it repeat at once. The others are cut into smaller blocks
    (and meet one representative of those already settled), so a context makes a few rows per step, not one per string.
    """
    columns = ["gram", "rim", "row_id", "start", "lead", "bytes"]
    active = contexts.select(*columns, F.lit(0).alias("block"))
    found, before = None, None
    for size in _BLOCKS:
        rows = cut(spark, _blocks(active, threshold, size, before), "blocks")
        before = size
        here = ["gram", "block", "common"]
        counts = rows.groupBy(*here).agg(F.count("*").alias("n")).where("n > 1").drop("n")
        spans = rows.groupBy("gram", "block", "spanned").agg(F.count("*").alias("n")).where("n > 1").drop("n")
        met = (rows.join(counts, here).join(spans.withColumn("settled", F.lit(True)), ["gram", "block", "spanned"], "left")
               .withColumn("settled", F.coalesce("settled", F.lit(size == 1))))
        met = cut(spark, met, "blocks")
        settled = met.where("rim AND settled").select("row_id", F.col("from").alias("start"), F.col("to").alias("stop"))
        found = settled if found is None else found.unionByName(settled)
        if size == 1:
            return found
        open_groups = met.where("rim AND NOT settled").select(*here).distinct()
        going = met.join(open_groups, here)
        one = F.struct("row_id", "start", "lead", "bytes")
        partners = (going.where("settled OR NOT rim").groupBy("gram", "block", "spanned").agg(F.min(one).alias("one"))
                    .select("gram", F.lit(False).alias("rim"), "one.*", "block"))
        active = going.where("rim AND NOT settled").select(*columns, "block").unionByName(partners)
    return found


_BLOCKS = (64, 16, 4, 1)


def _blocks(active: DataFrame, threshold: int, size: int, before: int | None) -> DataFrame:
    """Every context with each of its blocks of ``size`` offsets inside its block of ``before`` offsets (None: all), the hash
    of what the block's strings share (``common``), of what they span (``spanned``), and that range (``from, to``)."""
    names = ["gram", "rim", "row_id", "start", "lead", "bytes", "block", "common", "spanned", "from", "to"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch):
                start, lead, parent = (piece.column(c).to_numpy() for c in ("start", "lead", "block"))
                column = piece.column("bytes")
                ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
                data = np.frombuffer(column.buffers()[2], np.uint8)[ends[0]:ends[-1]]
                ends = ends - ends[0]
                # String i of a context lies lead - i before the anchor.
                low = lead - (np.diff(ends) - threshold)
                first, last = low // size, lead // size
                if before is not None:
                    first = np.maximum(first, parent * (before // size))
                    last = np.minimum(last, (parent + 1) * (before // size) - 1)
                n = last - first + 1
                row = np.repeat(np.arange(len(n)), n)
                block = first[row] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                near, far = block * size, block * size + size - 1
                origin = ends[row] + lead[row]
                prefix = _FIRST.prefix(data)
                # Shared by all offsets of the block, whether the context has them all or not (nothing if it is too wide).
                share = _FIRST.ranges(prefix, origin - near, np.maximum(origin - far + threshold, origin - near))
                near, far = np.maximum(near, low[row]), np.minimum(far, lead[row])
                begin, end = origin - far, origin - near + threshold
                span = mix(_FIRST.ranges(prefix, begin, end) + (near * 4096 + far).astype(np.uint64))
                shift = start[row] - ends[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(c).take(take) for c in names[:6]]
                    + [pa.array(block), pa.array(share.view(np.int64)), pa.array(span.view(np.int64)),
                       pa.array(begin + shift), pa.array(end + shift)], names=names)

    schema = "gram long, rim boolean, row_id long, start long, lead long, bytes binary, block long, common long, spanned long, `from` long, `to` long"
    return active.select(*names[:6], F.col("block").cast("long").alias("block")).mapInArrow(run, schema)


def _heavy_pieces(twice: DataFrame, light: int, heavy_list: int) -> tuple[DataFrame, DataFrame | None]:
    """Pieces that occur more than ``light`` times: the hottest, at most ``heavy_list`` of them, and the others (None: none).

    If all are too many, the hottest are those with more than a ``heavy_list``-th of the heavy anchors, of which there are
    fewer than ``heavy_list``. Each of the others then holds at most that share of the anchors.
    """
    heavy = twice.where(F.col("n") > light)
    pieces, anchors = heavy.agg(F.count("*"), F.sum("n")).first()
    if pieces <= heavy_list:
        return heavy.select("gram"), None
    most = anchors // heavy_list
    return heavy.where(F.col("n") > most).select("gram"), heavy.where(F.col("n") <= most).select("gram")


def repeated_spans(spark: SparkSession, docs: DataFrame, threshold: int = THRESHOLD, gram: int = GRAM,
                   light: int = LIGHT, heavy_list: int = HEAVY_LIST, crowded: int = CROWDED) -> DataFrame:
    """``row_id, start, stop``: byte ranges of ``docs(row_id long, text)`` whose strings repeat (ranges may overlap)."""
    twice = cut(spark, _anchor_rows(docs, threshold, gram, only_gram=True).groupBy("gram")
                .agg(F.count("*").alias("n")).where("n > 1"), "pieces")
    hottest, other_heavy = _heavy_pieces(twice, light, heavy_list)
    # The offsets are part of the second digit: equal ranges at equal offsets hold equal strings.
    digit = ["gram", "spread", "shape"]
    anchors = _anchor_rows(docs, threshold, gram).withColumn("shape", F.expr("at & 16777215"))
    # At most heavy_list longs.
    few = F.broadcast(hottest)
    group, piece = Window.partitionBy(*digit), Window.partitionBy("gram")
    sorted_light = (anchors.join(few, "gram", "left_anti").join(twice.where(F.col("n") <= light).select("gram"), "gram")
                    .withColumn("n", F.count("*").over(group))
                    .withColumn("nth", F.row_number().over(group.orderBy("row_id", "at")))
                    .withColumn("rims", F.sum(F.expr("CAST(n = 1 AS int)")).over(piece)))
    role = F.expr("CASE WHEN n = 1 THEN 2 WHEN nth = 1 AND rims > 0 THEN 1 ELSE 0 END")
    states = cut(spark, sorted_light.select("row_id", "at", role.alias("role"),
                                            F.when(role > 0, F.col("gram")).alias("gram")), "light")
    first = F.expr("(at >> 24) - ((at >> 12) & 4095)")
    stop = F.expr("(at >> 24) - (at & 4095)") + threshold

    members = anchors.join(few, "gram")
    if other_heavy is not None:
        members = members.unionByName(anchors.join(few, "gram", "left_anti").join(other_heavy.hint("merge"), "gram"))
    members = cut(spark, members, "heavy")
    groups = cut(spark, members.groupBy(*digit).agg(F.count("*").alias("n"), F.min(F.struct("row_id", "at")).alias("one")),
                 "groups")
    # One group may hold most members: they stay where they are as long as the list of groups can be broadcast.
    several = broadcast_if_small(groups.where("n > 1").select(*digit), heavy_list)
    # A heavy piece with few different surroundings is as small as a light one by now.
    crowd = groups.groupBy("gram").agg(F.count("*").alias("classes"), F.min("n").alias("n")).where("n = 1").drop("n")
    listed_heavy = groups.join(crowd, "gram").select("one.row_id", "one.at", "gram", F.expr("n = 1").alias("rim"),
                                                     (F.col("classes") > crowded).alias("heavy"))
    whole = (states.where("role < 2").select("row_id", "at")
             .unionByName(members.join(several, digit).select("row_id", "at"))
             .select("row_id", first.alias("start"), stop.alias("stop")))
    listed = (states.where("role > 0").select("row_id", "at", "gram", F.expr("role = 2").alias("rim"),
                                              F.lit(False).alias("heavy")).unionByName(listed_heavy))
    contexts = cut(spark, _contexts(docs, listed, threshold), "contexts")
    out = whole.unionByName(_light_rims(contexts, threshold))
    heavy_contexts = contexts.where("heavy")
    return out if heavy_contexts.isEmpty() else out.unionByName(_heavy_rims(spark, heavy_contexts, threshold))


def remove_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: int = THRESHOLD, gram: int = GRAM, light: int = LIGHT,
                   heavy_list: int = HEAVY_LIST, crowded: int = CROWDED) -> DataFrame:
    """``doc_id, n_bytes, removed, kept`` per input row: ``removed`` holds the maximal removed byte ranges
    (``start, stop``), ``kept`` the remaining bytes.

    Null text is empty; texts shorter than the threshold are kept whole. Repeated rows repeat each other's
    text. Null and repeated doc_ids are fine: rows are told apart by a number of their own, written down once.
    An empty table gives an empty result.
    """
    if not gram <= threshold < 2048:
        raise ValueError("threshold must be at least gram and below 2048")
    numbered = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = number_rows(spark, numbered).drop("rank")
    spans = repeated_spans(spark, rows.select("row_id", "text"), threshold, gram, light, heavy_list, crowded)
    # A range is shorter than 2 * threshold + 1: both ends fit one long.
    listed = (spans.select("row_id", F.expr("(start << 12) | (stop - start)").alias("span"))
              .groupBy("row_id").agg(F.collect_list("span").alias("spans")))
    return _apply(_packed(rows).join(listed, "row_id", "left"))


_RANGES = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))


def _merged(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and stops of the union of packed ranges."""
    spans = np.sort(spans)
    start, stop = spans >> 12, np.maximum.accumulate((spans >> 12) + (spans & 4095))
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], stop[np.append(np.flatnonzero(new)[1:], len(spans)) - 1]


def _apply(joined: DataFrame) -> DataFrame:
    schema = T.StructType([joined.schema["doc_id"], T.StructField("n_bytes", T.LongType()),
                           T.StructField("removed", _RANGES), T.StructField("kept", T.BinaryType())])
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in _pieces(batch, 1 << 9):
                removed, kept = [], []
                for r in range(piece.num_rows):
                    text = _unpack(piece.column(1)[r].as_py(), piece.column(2)[r].as_py())
                    if not piece.column(3)[r].is_valid:
                        removed.append([])
                        kept.append(text.tobytes())
                        continue
                    start, stop = _merged(piece.column(3)[r].values.to_numpy())
                    change = np.zeros(len(text) + 1, np.int8)
                    change[start] += 1
                    change[stop] -= 1
                    keep = np.cumsum(change[:-1], dtype=np.int8) == 0
                    removed.append([{"start": s, "stop": e} for s, e in zip(start.tolist(), stop.tolist())])
                    kept.append(text[keep].tobytes())
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(removed, kind),
                                                  pa.array(kept, pa.binary())], names=schema.names)

    return joined.select("doc_id", "n_bytes", "blob", "spans").mapInArrow(run, schema)


def digest(found: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` from ``remove_repeats``'s columns."""
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                        F.sha2("kept", 256).alias("kept_sha256"))
