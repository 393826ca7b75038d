"""Prefix trie of conversations, with subtree totals by time-forward processing.

A conversation's turns are ordered and *rebuilt*: the first h turns of conversation c - c % 5, then its own after its
first h. A node is a distinct sequence of first d rebuilt turns. It is known by its depth and two 64-bit XOR sums over
the turns' digests with their places, so each prefix costs one XOR; a node's *name* is (smallest member, depth).

In order of names a child comes after its parent, and the nodes with one smallest member are a downward path. Nodes are
dealt into shards, ranges of names of equal size, so neither a first turn that a third of the conversations share nor one
very long conversation makes a large shard. Within a shard nodes are sorted by reverse level order and totals travel to
parents through a priority queue that spills (``Messages``). A node whose parent lies in an earlier shard is a shard
root; roots of a shard under one outside parent form a *link*. The links are a small tree; their totals are settled by
doubling (each round halves every path), and enter the shards as initial values of a second pass.

Defined results: rows without a conv_id belong to no conversation. Null role or text is empty. Turns with equal numbers
(null among them) are ordered by the MD5 digest of role and text, so repeated rows stay and their order does not matter.
Other columns are ignored. An empty table has no nodes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.storage import cut

#: Conversations are rebuilt within groups of FAMILY ids, taking fewer than MAX_BORROWED turns.
FAMILY = 5
MAX_BORROWED = 9
#: A conversation is numbered and summed in pieces: turns whose numbers share all but the last 12 bits.
PIECE_BITS = 12
#: Aim for the nodes of a shard; messages that a queue holds in memory before it writes a run.
SHARD_NODES = 1 << 20
QUEUE_ROWS = 1 << 20
#: Ids joined into one text before they are hashed in order.
ENDS_PER_PIECE = 1 << 16


def _xor(column: str, rows: str = "") -> str:
    return f"coalesce(bit_xor({column}){rows}, 0L)"


def _terms(depth: str) -> list[str]:
    return [f"xxhash64({i}, CAST({depth} AS BIGINT), k) AS t{i}" for i in (1, 2)]


def rebuild(spark: SparkSession, conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt turns ``conv_id, depth, x1, x2, p1, p2, bytes, ends`` (p: sums of the parent) and conversations ``conv_id, n_turns``.

    Role and text are reduced to a digest and a length before anything moves.
    """
    is_number = isinstance(conversations.schema["turn"].dataType, T.NumericType)
    piece = f"CAST(floor(turn / {1 << PIECE_BITS}) AS BIGINT)" if is_number else "CAST(0 AS BIGINT)"
    turns = conversations.where("conv_id IS NOT NULL").selectExpr(
        "CAST(conv_id AS BIGINT) AS conv_id", "turn", f"coalesce({piece}, {-(1 << 63) + 1}L) AS piece",
        "unhex(md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS k",
        "CAST(octet_length(coalesce(text, '')) AS BIGINT) AS bytes")
    here = Window.partitionBy("conv_id", "piece").orderBy(F.col("turn").asc_nulls_first(), "k")
    numbered = turns.withColumn("local", F.row_number().over(here))

    pieces = cut(spark, turns.groupBy("conv_id", "piece").agg(F.count("*").alias("n")), "pieces")
    whole = pieces.groupBy("conv_id").agg(F.sum("n").alias("total"))
    heads = whole.selectExpr("conv_id", "total", f"conv_id - pmod(conv_id, {FAMILY}) AS base",
                             f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {MAX_BORROWED} AS BIGINT) AS h")
    heads = heads.join(whole.toDF("base", "base_total"), "base", "left").selectExpr(
        "conv_id", "base", "h", "least(h, coalesce(base_total, 0)) AS taken", "total")
    heads = cut(spark, heads.withColumn("n_turns", F.expr("taken + greatest(total - h, 0)")), "heads")

    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    places = (pieces.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
              .join(heads.select("conv_id", "h", "taken", "n_turns"), "conv_id"))
    own = numbered.join(places.drop("n"), ["conv_id", "piece"]).selectExpr(
        "*", "local + before AS pos").selectExpr("*", "taken + pos - h AS depth").selectExpr("*", *_terms("depth"))
    rows = " OVER (PARTITION BY conv_id, piece ORDER BY pos ROWS UNBOUNDED PRECEDING)"
    own = cut(spark, own.selectExpr("conv_id", "piece", "pos", "h", "n_turns", "depth", "k", "bytes", "t1", "t2", *[
        f"{_xor(f'IF(pos > h, t{i}, 0L)', rows)} AS s{i}" for i in (1, 2)]), "turns")

    # The first turns of the families' first conversations: fewer than MAX_BORROWED rows each.
    first = (own.where(f"pmod(conv_id, {FAMILY}) = 0 AND pos < {MAX_BORROWED}").selectExpr("conv_id AS base", "pos", "bytes", *_terms("pos"))
             .groupBy("base").agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "bytes"))).alias("first")))
    lent = heads.where("taken > 0").join(first, "base")
    upto = lambda i, n: f"aggregate(slice(first, 1, CAST({n} AS INT)), 0L, (a, e) -> a ^ e.t{i})"
    borrowed = (lent.withColumn("depth", F.explode(F.expr("sequence(1L, taken)")))
                .selectExpr("conv_id", "depth", f"{upto(1, 'depth')} AS x1", f"{upto(2, 'depth')} AS x2", f"{upto(1, 'depth - 1')} AS p1",
                            f"{upto(2, 'depth - 1')} AS p2", "first[CAST(depth AS INT) - 1].bytes AS bytes", "depth = n_turns AS ends"))

    # Sums at the start of every piece: what was borrowed, and the pieces before.
    starts = lent.selectExpr("conv_id", f"{upto(1, 'taken')} AS b1", f"{upto(2, 'taken')} AS b2")
    sums = own.where("pos > h").groupBy("conv_id", "piece").agg(F.expr("bit_xor(t1)").alias("t1"), F.expr("bit_xor(t2)").alias("t2"))
    before = " OVER (PARTITION BY conv_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    sums = (sums.selectExpr("conv_id", "piece", f"{_xor('t1', before)} AS z1", f"{_xor('t2', before)} AS z2")
            .join(starts, "conv_id", "left").selectExpr("conv_id", "piece", *[f"z{i} ^ coalesce(b{i}, 0L) AS z{i}" for i in (1, 2)]))
    kept = own.where("pos > h").join(sums, ["conv_id", "piece"]).selectExpr(
        "conv_id", "depth", "s1 ^ z1 AS x1", "s2 ^ z2 AS x2", "s1 ^ t1 ^ z1 AS p1", "s2 ^ t2 ^ z2 AS p2", "bytes", "depth = n_turns AS ends")
    return cut(spark, borrowed.unionByName(kept), "rebuilt"), heads.select("conv_id", "n_turns")


def _nodes(spark: SparkSession, rebuilt: DataFrame, heads: DataFrame) -> DataFrame:
    """``rep, depth, prep, n_convs, leaf, saved, x1, x2`` of every node; ``prep`` is the parent's smallest member (the root's: its own)."""
    below = cut(spark, rebuilt.groupBy("depth", "x1", "x2").agg(
        F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("p1").alias("p1"),
        F.max("p2").alias("p2"), F.expr("count_if(ends)").alias("n_ends")), "nodes")
    root = heads.agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.expr("count_if(n_turns = 0)").alias("n_ends"))
    root = root.where("n_convs > 0").selectExpr("0L AS depth", "0L AS x1", "0L AS x2", "rep", "n_convs", "n_ends")
    first = root.first()
    parents = below.selectExpr("depth + 1 AS depth", "x1 AS p1", "x2 AS p2", "rep AS prep")
    kept = ["rep", "depth", "prep", "n_convs", "n_ends = n_convs AS leaf", "(n_convs - 1) * bytes AS saved", "x1", "x2"]
    return (below.where("depth > 1").join(parents, ["depth", "p1", "p2"]).selectExpr(*kept)
            .unionByName(below.where("depth = 1").withColumn("prep", F.lit(first and first.rep).cast("long")).selectExpr(*kept))
            .unionByName(root.selectExpr("*", "rep AS prep", "0L AS bytes").selectExpr(*kept)))


class Messages:
    """Priority queue of (key, figures) between two levels: later keys wait, equal keys add up.

    What is put while a level is read belongs to the next one. At most ``limit`` rows are held; beyond, the sorted and
    summed rows go to a nameless scratch file of the task (as Spark's own sorts spill; nobody else reads it), and
    ``take`` merges the runs in order of key.
    """

    def __init__(self, width: int, limit: int | None = None):
        self._width, self._limit = width, limit or QUEUE_ROWS
        self._coming: list[np.ndarray] = []
        self._rows = 0
        self._spilled: list[list] = []
        self._ready: list[list] = []

    def _summed(self, parts: list[np.ndarray]) -> np.ndarray:
        rows = np.concatenate(parts) if parts else np.empty((0, 1 + self._width), np.int64)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]])) if len(rows) else np.empty(0, np.int64)
        if not len(rows):
            return rows
        return np.concatenate([rows[starts, :1], np.add.reduceat(rows[:, 1:], starts)], axis=1)

    def put(self, key: np.ndarray, *figures: np.ndarray) -> None:
        self._coming.append(np.stack([key, *figures], axis=1).astype(np.int64))
        self._rows += len(key)
        if self._rows > self._limit:
            rows = self._summed(self._coming)
            if len(rows) * 2 > self._limit:
                run = tempfile.TemporaryFile()
                rows.tofile(run)
                self._spilled.append([run, len(rows), None])
                rows = rows[:0]
            self._coming, self._rows = [rows], len(rows)

    def next_level(self) -> None:
        """Offer what was put since the last call."""
        for run, _, _ in self._ready:
            if run is not None:
                run.close()
        for run in self._spilled:
            run[0].seek(0)
        self._ready = [*self._spilled, [None, 0, self._summed(self._coming)]]
        self._coming, self._rows, self._spilled = [], 0, []

    def take(self, last: int) -> np.ndarray:
        """Rows with keys up to ``last`` that were not taken before, one per key."""
        found = []
        for source in self._ready:
            while True:
                run, left, block = source
                if block is not None and len(block):
                    n = int(np.searchsorted(block[:, 0], last, side="right"))
                    found.append(block[:n])
                    source[2] = block[n:]
                    if n < len(block):
                        break
                if not left:
                    break
                n = min(left, max(1, self._limit // 16))
                source[1], source[2] = left - n, np.fromfile(run, np.int64, n * (1 + self._width)).reshape(n, -1)
        return self._summed(found)


def _climb(nodes: DataFrame, shards: int) -> DataFrame:
    """``nodes`` with ``children, leaves, saved`` summed over what lies below them in their shard (their own values included)."""
    columns = ["shard", "depth", "rep", "prep", "inside", "children", "leaves", "saved", "n_convs", "x1", "x2"]
    dealt = (nodes.select(*columns).repartitionById(shards, F.col("shard").cast("int"))
             .sortWithinPartitions("shard", F.col("depth").desc(), "rep"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, queue = None, Messages(3)
        for batch in batches:
            shard, depth, rep, prep = (np.asarray(batch.column(i)) for i in range(4))
            inside = np.asarray(batch.column(4).cast(pa.int8())).astype(bool)
            totals = np.stack([np.asarray(batch.column(i)) for i in (5, 6, 7)], axis=1)
            cuts = np.flatnonzero(np.concatenate([[True], (shard[1:] != shard[:-1]) | (depth[1:] != depth[:-1])])).tolist()
            for a, b in zip(cuts, cuts[1:] + [len(shard)], strict=True):
                if here != (shard[a], depth[a]):
                    if here is None or here[0] != shard[a]:
                        queue = Messages(3)
                    queue.next_level()
                    here = (shard[a], depth[a])
                got = queue.take(int(rep[b - 1]))
                totals[a + np.searchsorted(rep[a:b], got[:, 0])] += got[:, 1:]
                up = a + np.flatnonzero(inside[a:b])
                if len(up):
                    queue.put(prep[up], np.ones(len(up), np.int64), totals[up, 1], totals[up, 2])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], *[pa.array(np.ascontiguousarray(totals[:, i])) for i in range(3)], *batch.columns[8:]], names=columns)

    return dealt.mapInArrow(run, dealt.schema)


def _paths(nodes: DataFrame, shards: int) -> DataFrame:
    """``shard, rep, low, high, op_rep, op_depth``: every downward path of a shard, and the outside parent above its shard root."""
    tops = nodes.groupBy("shard", "rep").agg(F.min("depth").alias("low"), F.max("depth").alias("high"),
                                             F.min_by("prep", "depth").alias("prep"), F.min_by("inside", "depth").alias("inside"))
    dealt = tops.repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "rep")
    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("shard", "rep", "low", "high", "op_rep", "op_depth")])

    def solve(table: pa.Table) -> pa.RecordBatch:
        shard, rep, low, high, prep = (np.asarray(table.column(i)) for i in range(5))
        inside = np.asarray(table.column(5).combine_chunks().cast(pa.int8())).astype(bool)
        above = np.arange(len(rep))
        above[inside] = np.searchsorted(rep, prep[inside])
        while (above[above] != above).any():
            above = above[above]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (shard, rep, low, high, prep[above], low[above] - 1)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A shard has about SHARD_NODES nodes and no more paths than that.
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])).tolist()
            for a, b in zip(cuts, cuts[1:] + [len(shard)], strict=True):
                if held and held[-1].column(0)[0].as_py() != shard[a]:
                    yield solve(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield solve(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, schema)


def _settle(spark: SparkSession, links: DataFrame) -> DataFrame:
    """``links`` (``link, above, leaves, saved``) with leaves and saved summed over all links below: pointer doubling."""
    while not links.where("above IS NOT NULL").isEmpty():
        gained = links.where("above IS NOT NULL").groupBy(F.col("above").alias("link")).agg(
            F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        next_up = links.selectExpr("link AS above", "above AS higher")
        links = cut(spark, links.join(gained, "link", "left").join(next_up, "above", "left").selectExpr(
            "link", "higher AS above", "op_rep", "op_depth", "children", "leaves + coalesce(more_leaves, 0) AS leaves",
            "saved + coalesce(more_saved, 0) AS saved"), "trie-links")
    return links


def _ends(ends: DataFrame) -> DataFrame:
    """``depth, x1, x2, ends_sha256``: digest of the ids (ascending, comma-joined) that end at a node.

    Ids are sorted over all tasks and joined to texts of up to ENDS_PER_PIECE; a node's texts are then hashed in order, as SHA-256 must be.
    """
    key = ["depth", "x1", "x2"]
    schema = T.StructType([T.StructField(c, T.LongType()) for c in (*key, "first")] + [T.StructField("ids", T.StringType())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ENDS_PER_PIECE):
                part = batch.slice(start, ENDS_PER_PIECE)
                depth, x1, x2, conv = (np.asarray(c) for c in part.columns)
                cuts = np.flatnonzero(np.concatenate([[True], (depth[1:] != depth[:-1]) | (x1[1:] != x1[:-1]) | (x2[1:] != x2[:-1])]))
                ids = conv.tolist()
                texts = [",".join(map(str, ids[a:b])) for a, b in zip(cuts.tolist(), cuts.tolist()[1:] + [len(ids)], strict=True)]
                yield pa.RecordBatch.from_arrays([*[pa.array(c[cuts]) for c in (depth, x1, x2, conv)], pa.array(texts, pa.string())], names=schema.names)

    out = T.StructType([T.StructField(c, T.LongType()) for c in key] + [T.StructField("ends_sha256", T.StringType())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, sha = None, None
        for batch in batches:
            done = []
            for d, a, b, ids in zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4)], strict=True):
                if (d, a, b) == here:
                    sha.update(b"," + ids.encode())
                    continue
                if here:
                    done.append((*here, sha.hexdigest()))
                here, sha = (d, a, b), hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_pylist([dict(zip(out.names, r, strict=True)) for r in done],
                                             pa.schema([(c, pa.int64()) for c in key] + [("ends_sha256", pa.string())]))
        if here:
            yield pa.RecordBatch.from_pydict({c: [v] for c, v in zip(out.names, (*here, sha.hexdigest()), strict=True)})

    texts = ends.repartitionByRange(*key, "conv_id").sortWithinPartitions(*key, "conv_id").mapInArrow(join, schema)
    return texts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, out)


def trie(spark: SparkSession, conversations: DataFrame, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conv_id`` is the smallest member; ``saved_tokens`` sums (members - 1) * bytes of the last text over the subtree.
    """
    rebuilt, heads = rebuild(spark, conversations)
    nodes = cut(spark, _nodes(spark, rebuilt, heads), "trie-nodes")
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-nodes.count() // shard_nodes))
    dealt = nodes.repartitionByRange(shards, "rep", "depth").withColumn("shard", F.spark_partition_id().cast("long"))
    dealt = cut(spark, dealt, "trie-shards")
    # One row per shard.
    lows = F.broadcast(dealt.groupBy("shard").agg(F.min(F.struct("rep", "depth")).alias("low")))
    dealt = dealt.join(lows, "shard").selectExpr(
        "shard", "rep", "depth", "prep", "n_convs", "x1", "x2", "named_struct('rep', prep, 'depth', depth - 1) >= low AS inside",
        "CAST(leaf AS BIGINT) AS leaves", "saved")

    empty = dealt.withColumn("children", F.lit(0).cast("long"))
    roots = cut(spark, _climb(empty, shards).where("NOT inside").groupBy(
        "shard", F.col("prep").alias("op_rep"), (F.col("depth") - 1).alias("op_depth")).agg(
        F.count("*").alias("children"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "trie-roots")
    name = "concat_ws(':', {}, op_rep, op_depth)".format
    paths = _paths(dealt, shards).selectExpr("rep", "low", "high", f"{name('shard')} AS above")
    links = roots.join(paths, (F.col("op_rep") == F.col("rep")) & F.col("op_depth").between(F.col("low"), F.col("high")), "left")
    links = cut(spark, links.selectExpr(f"{name('shard')} AS link", "above", "op_rep", "op_depth", "children", "leaves", "saved"), "trie-links")
    outside = _settle(spark, links).groupBy(F.col("op_rep").alias("rep"), F.col("op_depth").alias("depth")).agg(
        F.sum("children").alias("children"), F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))

    full = dealt.join(outside, ["rep", "depth"], "left").selectExpr(
        "shard", "rep", "depth", "prep", "inside", "n_convs", "x1", "x2", "coalesce(children, 0L) AS children",
        "leaves + coalesce(more_leaves, 0L) AS leaves", "saved + coalesce(more_saved, 0L) AS saved")
    ends = rebuilt.where("ends").select("depth", "x1", "x2", "conv_id").unionByName(
        heads.where("n_turns = 0").selectExpr("0L AS depth", "0L AS x1", "0L AS x2", "conv_id"))
    return _climb(full, shards).join(_ends(ends), ["depth", "x1", "x2"], "left").selectExpr(
        "rep AS conv_id", "depth", "IF(depth = 0, NULL, prep) AS parent_conv_id", "n_convs", "children AS n_children", "leaves AS n_leaves",
        "saved AS saved_tokens", "coalesce(ends_sha256, sha2('', 256)) AS ends_sha256")
