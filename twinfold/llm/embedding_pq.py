"""Near-duplicate embeddings by product quantisation, within labels.

Vectors are scaled to unit length, so a cosine of at least t is a distance of at most r = sqrt(2 - 2t).

1. Exact copies (same label, same components) become one row with a count.
2. A coarse quantiser and codebooks for the residuals' subspaces are fitted on the ``SAMPLE`` rows of smallest id hash (a bound, not
   a share). Every row is indexed: it belongs to the list of its nearest centroid, with one code per subspace and the length of
   what the codes leave.
3. A row visits each other list whose cell begins within r * min(1, ``SIGMAS`` / sqrt(dimension)) of it (of two lists, the one
   with the larger number is visited). Up to SIGMAS**2 dimensions this loses nothing; beyond, a partner is missed only where
   the whole difference lies more than SIGMAS standard deviations along one boundary. Recall is measured in the tests.
4. In a list, table look-ups give the distance from a visitor to every coded member; by the triangle inequality a member farther than
   r plus its code's error cannot be a partner. The rest are compared exactly, in double precision.
5. Links are counted where they are found and never written as pairs; what leaves a list is one count and one edge per vector,
   from which components are made.

A list of more than ``BLOCK`` rows is split into blocks, and its visitors go to each block.

Defined results: vectors that are null, empty, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different lengths do not link. Rows without a vec_id, and rows that repeat one, count as vectors of their
own; a component without any id has a null ``component_id``. ``kept`` is null-safe equality. An empty table gives an empty result.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.components import components
from twinfold.llm.storage import broadcast_if_small, cut, number_rows

THRESHOLD = 0.98
SAMPLE = 16_384
LIST_ROWS, MAX_LISTS = 1024, 1024
SUBSPACE, CODES = 8, 256
SIGMAS = 4.0
BLOCK = 4096
#: Rows of a table of crowded lists (four numbers each) that may be broadcast.
MAX_BROADCAST = 1_000_000
#: Visitors compared at a time with a block.
VISITORS = 256
#: Room for rounding in bounds on distances (cosines themselves are compared as they are).
SLACK = 1e-6


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of the rows of ``x`` by Lloyd's algorithm from a random start (fewer if there are fewer distinct rows)."""
    start = np.unique(x, axis=0)
    centres = start[np.random.default_rng(seed).permutation(len(start))[:k]]
    for _ in range(rounds):
        near = nearest(x, centres)
        size = np.bincount(near, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        centres = np.where(size[:, None] > 0, total / np.maximum(size, 1)[:, None], centres)
    return centres


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances, rows of ``x`` by centres."""
    return np.maximum((x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T, 0)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    parts = [squared(x[i:i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.empty(0, np.int64)


class Index:
    """Coarse centroids and subspace codebooks for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, threshold: float):
        dim = sample.shape[1]
        self.radius = float(np.sqrt(max(0.0, 2 - 2 * threshold)))
        self.reach = self.radius * min(1.0, SIGMAS / np.sqrt(dim)) + SLACK
        self.centroids = kmeans(sample, lists, 1) if len(sample) else np.zeros((1, dim))
        self.parts = [p for p in np.array_split(np.arange(dim), max(1, dim // SUBSPACE))]
        rest = sample - self.centroids[nearest(sample, self.centroids)]
        self.books = [kmeans(rest[:, p], CODES, 2 + i) if len(rest) else np.zeros((1, len(p))) for i, p in enumerate(self.parts)]
        self._apart = np.sqrt(squared(self.centroids, self.centroids))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Home list of every row, and which lists it visits (rows by lists)."""
        d = squared(x, self.centroids)
        home = d.argmin(1)
        gap = (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * self._apart[home], SLACK)
        return home, (gap <= self.reach) & (np.arange(len(self.centroids)) > home[:, None])

    def encode(self, x: np.ndarray, home: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes of rows of one list, and the distance of each to what its codes stand for."""
        rest = x - self.centroids[home]
        codes = np.stack([nearest(rest[:, p], b) for p, b in zip(self.parts, self.books, strict=True)], axis=1)
        coded = np.empty_like(rest)
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            coded[:, p] = b[codes[:, i]]
        return codes, np.sqrt(((rest - coded) ** 2).sum(1))

    def distances(self, x: np.ndarray, home: int, codes: np.ndarray) -> np.ndarray:
        """Distances from rows of ``x`` to coded members of a list: one table per subspace, one look-up per code."""
        rest = x - self.centroids[home]
        total = np.zeros((len(x), len(codes)))
        for i, (p, b) in enumerate(zip(self.parts, self.books, strict=True)):
            total += squared(rest[:, p], b)[:, codes[:, i]]
        return np.sqrt(total)


def unit(rows: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 (first by their largest component, so that no square overflows)."""
    rows = rows / np.abs(rows).max(1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column (no nulls, equal lengths) as double rows."""
    flat = np.asarray(column.flatten(), np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def union(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` (a class name per member, itself a member) after the classes of every pair (a, b) are joined."""
    name, a, b = np.arange(len(root)), root[a], root[b]
    while True:
        low = np.minimum(name[a], name[b])
        if (name[a] == low).all() and (name[b] == low).all():
            return name[root]
        np.minimum.at(name, a, low)
        np.minimum.at(name, b, low)


class _Group:
    """The members of one block of a list; compares visitors with them and keeps counts and roots."""

    def __init__(self, index: Index, home: int, threshold: float):
        self._index, self._home, self._threshold = index, home, threshold
        self._parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._ready = False

    def add(self, ids: np.ndarray, times: np.ndarray, x: np.ndarray) -> None:
        self._parts.append((ids, times, x))

    def close(self) -> None:
        """No more members: code them and compare them with each other."""
        if self._ready:
            return
        self._ready = True
        if not self._parts:
            return
        self.ids, self._times, self._x = (np.concatenate(p) for p in zip(*self._parts, strict=True))
        self._codes, self._error = self._index.encode(self._x, self._home)
        self.links, self._root = np.zeros(len(self.ids), np.int64), np.arange(len(self.ids))
        for i in range(0, len(self.ids), VISITORS):
            a, b = self._pairs(self._x[i:i + VISITORS])
            a, b = a[a + i < b] + i, b[a + i < b]
            np.add.at(self.links, a, self._times[b])
            np.add.at(self.links, b, self._times[a])
            self._root = union(self._root, a, b)

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of members that have links, a member linked with each (itself or its class), and how many links."""
        self.close()
        if not self._parts:
            return (np.empty(0, np.int64),) * 3
        hit = np.flatnonzero(self.links)
        return self.ids[hit], self.ids[self._root[hit]], self.links[hit]

    def _pairs(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = self._index.distances(x, self._home, self._codes) <= self._index.radius + self._error + SLACK
        a, b = np.nonzero(near)
        kept = []
        for i in range(0, len(a), 1 << 16):
            kept.append(np.einsum("ij,ij->i", x[a[i:i + (1 << 16)]], self._x[b[i:i + (1 << 16)]]) >= self._threshold)
        good = np.concatenate(kept) if kept else np.zeros(0, bool)
        return a[good], b[good]

    def visit(self, ids: np.ndarray, times: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of visitors that have links here, one linked member of each, and how many links."""
        self.close()
        for i in range(0, len(ids) if self._parts else 0, VISITORS):
            a, b = self._pairs(x[i:i + VISITORS])
            if not len(a):
                continue
            own, n = ids[i:i + VISITORS], times[i:i + VISITORS]
            links = np.zeros(len(own), np.int64)
            np.add.at(links, a, self._times[b])
            np.add.at(self.links, b, n[a])
            hit, first = np.unique(a, return_index=True)
            self._root = union(self._root, np.repeat(b[first], np.diff([*first, len(a)])), b)
            yield own[hit], self.ids[b[first]], links[hit]


_FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("u", "v", "n")])


def _found(u: np.ndarray, v: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, n)], names=_FOUND.names)


def _place(reps: DataFrame, model) -> DataFrame:
    """Rows ``label, dim, list, visitor, rep, copies, embedding``: every vector in its own list, and once per list it visits."""
    columns = ["label", "dim", "rep", "copies", "embedding"]
    source = reps.select(*columns)
    kinds = {f.name: f for f in source.schema.fields}
    schema = T.StructType([kinds["label"], kinds["dim"], T.StructField("list", T.IntegerType()), T.StructField("visitor", T.BooleanType()),
                           kinds["rep"], kinds["copies"], kinds["embedding"]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(1))
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                for i in range(0, len(at), 2048):
                    part = batch.take(pa.array(at[i:i + 2048]))
                    home, visits = model.value.at(int(dim)).place(unit(_matrix(part.column(4))))
                    row, there = np.nonzero(visits)
                    row = np.concatenate([np.arange(len(home)), row])
                    out = part.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays(
                        [out.column(0), out.column(1), pa.array(np.concatenate([home, there]), pa.int32()),
                         pa.array(np.arange(len(row)) >= len(home)), *out.columns[2:]], names=schema.names)

    return source.mapInArrow(run, schema)


class _Model:
    """Indexes by vector length; a length that the sample did not show has one list and no codes."""

    def __init__(self, samples: dict[int, np.ndarray], lists: dict[int, int], threshold: float):
        self._threshold = threshold
        self._by_dim = {dim: Index(x, lists[dim], threshold) for dim, x in samples.items()}

    def at(self, dim: int) -> Index:
        if dim not in self._by_dim:
            self._by_dim[dim] = Index(np.zeros((0, dim)), 1, self._threshold)
        return self._by_dim[dim]


def fit(reps: DataFrame, threshold: float = THRESHOLD) -> _Model:
    """Indexes fitted on the ``SAMPLE`` rows of smallest id hash; lists hold about ``LIST_ROWS`` rows of the largest label."""
    sample = reps.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE).select("dim", "embedding").toArrow()
    dims = np.asarray(sample.column(0))
    samples = {int(d): unit(_matrix(sample.column(1).combine_chunks().take(pa.array(np.flatnonzero(dims == d))))) for d in np.unique(dims)}
    most = reps.groupBy("label", "dim").count().where(F.col("dim").isin(list(samples))).groupBy("dim").agg(F.max("count").alias("n")).collect()
    return _Model(samples, {r.dim: int(min(MAX_LISTS, max(1, r.n // LIST_ROWS))) for r in most}, threshold)


def _blocks(placed: DataFrame) -> DataFrame:
    """``placed`` with ``block``: members of a crowded list are dealt into blocks; its later members and its visitors also go to each earlier block."""
    group = ["label", "dim", "list"]
    crowded = broadcast_if_small((placed.where("NOT visitor").groupBy(*group).agg(F.count("*").alias("rows")).where(F.col("rows") > BLOCK)
               .withColumn("blocks", F.ceil(F.col("rows") / BLOCK).cast("int")).drop("rows")), MAX_BROADCAST)
    dealt = placed.join(crowded, group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.expr("IF(visitor, blocks - 1, CAST(pmod(xxhash64(rep), blocks) AS INT))"))
    return (dealt.withColumn("block", F.explode(F.expr("sequence(0, own)")))
            .withColumn("visitor", F.expr("visitor OR block < own")).drop("own", "blocks"))


def _compare(blocks: DataFrame, model, threshold: float) -> DataFrame:
    """``u, v, n``: n links of u, and an edge from u to v where v is another vector; about one row per vector and list."""
    key = ["label", "dim", "list", "block"]
    dealt = (blocks.select(*key, "visitor", "rep", "copies", "embedding").repartition(*key)
             .sortWithinPartitions(*key, "visitor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, group = None, None

        def done() -> Iterator[pa.RecordBatch]:
            if group is not None:
                yield _found(*group.found())

        for batch in batches:
            keys = list(zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True))
            cuts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]] + [len(keys)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.slice(a, b - a)
                ids, times = np.asarray(part.column(5)), np.asarray(part.column(6))
                if keys[a][:4] != here:
                    yield from done()
                    here = keys[a][:4]
                    group = None if keys[a][4] else _Group(model.value.at(here[1]), here[2], threshold)
                if group is None:
                    continue
                x = unit(_matrix(part.column(7)))
                if keys[a][4]:
                    for found in group.visit(ids, times, x):
                        yield _found(*found)
                else:
                    group.add(ids, times, x)
        yield from done()

    return dealt.mapInArrow(run, _FOUND)


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
                    label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors`` (the id under its own name)."""
    plain = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).alias("label"))
    rows = number_rows(spark, plain, "vec_id")
    finite = "x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')"
    usable = f"label IS NOT NULL AND size(embedding) > 0 AND forall(embedding, x -> {finite}) AND exists(embedding, x -> x <> 0)"
    keyed = rows.selectExpr("row_id", "vec_id", "label", "embedding", f"coalesce({usable}, false) AS usable",
                            "xxhash64(embedding) AS k1", "xxhash64(1, embedding) AS k2")
    reps = cut(spark, keyed.where("usable").groupBy("label", "k1", "k2").agg(
        F.min("row_id").alias("rep"), F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.any_value("embedding").alias("embedding"))
        .withColumn("dim", F.size("embedding")), "vectors")
    model = spark.sparkContext.broadcast(fit(reps, threshold))
    placed = cut(spark, _place(reps, model), "lists")
    found = cut(spark, _compare(_blocks(placed), model, threshold), "found")
    roots = components(spark, found.where("u <> v"))
    links = found.groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("n"))
    classes = reps.select("label", "k1", "k2", "rep", "copies", "least").join(links, "rep", "left").join(
        roots.withColumnRenamed("node", "rep"), "rep", "left").selectExpr(
        "label", "k1", "k2", "copies - 1 + coalesce(n, 0) AS n_links", "coalesce(root, rep) AS root", "least")
    classes = cut(spark, classes, "classes")
    least = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = cut(spark, classes.drop("least").join(least, "root"), "classes")
    members = keyed.select("row_id", "vec_id", "label", "usable", "k1", "k2")
    linked = members.where("usable").join(classes, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = members.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return (linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
            .withColumnRenamed("vec_id", id_col))
