"""The fit loop (M7-M12): init, loss, Gauss-Seidel sweeps, stop, validation.

The driver only plans: every update is a DataFrame plan whose result is
written as parquet under ``spark.checkpoint.dir`` and read back, which cuts
the lineage after each update (the plan of iteration 50 is as small as the
plan of iteration 1) and makes every factor version durable, so an executor
loss costs a recomputation of one update at most. What reaches the driver
per iteration is a few scalars: losses, entry counts and column means.
"""

from __future__ import annotations

import math
import sys
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.functions.columns import entry_columns
from twinfold.operators.factors import (buckets_for_hashing, copy_factor, heavy_indices, heavy_table, init_factor,
                                        store_entries, stored_table)
from twinfold.operators.normal import mode_sums, sum_names, sums_schema
from twinfold.operators.predict import loss_table, mean_loss, rmse, training_loss
from twinfold.operators.tensor import check, check_and_digest, cluster_by_mode, partitions_for
from twinfold.operators.update import Side, update_shared, update_specific, update_uncoupled, use_gram
from twinfold.plans import commits
from twinfold.plans.layout import FactorKey, Layout, layout
from twinfold.session import fits_broadcast, run_dir
from twinfold.spec import Coupling, FitConfig, Tensor

FACTOR_SCHEMA = "idx long, v array<double>"
#: Share of the targets' squares below which a training error is summed entry by entry, not taken from the normal equations.
LEAST_ERROR = 1e-9
#: Bins per shuffle partition in which entries are counted before heavy indices are looked for.
HEAVY_BINS = 32

METRICS_SCHEMA = T.StructType([
    T.StructField("iter", T.IntegerType(), False),
    T.StructField("seconds", T.DoubleType(), False),
    T.StructField("term", T.StringType(), False),
    T.StructField("loss", T.DoubleType(), True),
])


class FactorStore:
    """Factor versions as parquet folders; each put cuts the lineage.

    The write itself measures what the loop needs to know of a factor (A1, A6, A8): its column means and the squared error
    of the update behind it are observed on the rows on their way to the files. They are counted in the tasks that write,
    whose results Spark takes once each, so no second job reads the factor and a task that is run again adds nothing.
    Without a rank only the rows are counted.
    """

    def __init__(self, spark: SparkSession, root: str, rank: int = 0):
        self.spark = spark
        self.root = root
        self.rank = rank
        self.means: dict[FactorKey, list[float]] = {}
        self.errors: dict[FactorKey, float] = {}
        self.paths: dict[FactorKey, str] = {}
        self.written: set[str] = set()
        self.frames: dict[FactorKey, DataFrame] = {}
        self.version = 0

    def put(self, key: FactorKey, df: DataFrame, tag: str) -> DataFrame:
        """Write one factor and load it; the ``sse`` column of an update that measured its error is summed, not written."""
        self.version += 1
        path = f"{self.root}/factors/{tag}/v{self.version:05d}_t{key[0]}_m{key[1]}"
        watch = Observation()
        sums = [F.count(F.lit(1)).alias("n")] + [F.avg(F.col("v")[c]).alias(f"m_{c}") for c in range(self.rank)]
        sums += [F.sum("sse").alias("sse")] if "sse" in df.columns else []
        df.observe(watch, *sums).select("idx", "v").write.mode("overwrite").parquet(path)
        self._note([key], watch.get, "sse" in df.columns)
        return self.load(key, path)

    def _note(self, keys: Sequence[FactorKey], seen: dict, with_error: bool = False) -> None:
        """Keep what the write of ``keys`` measured."""
        for i, key in enumerate(keys):
            self.means[key] = [float(seen[f"m_{i * self.rank + c}"]) for c in range(self.rank)]
            self.errors.pop(key, None)
            if with_error:
                self.errors[key] = float(seen["sse"] or 0.0)

    def put_many(self, frames: dict[FactorKey, DataFrame], tag: str) -> None:
        """Write several factors in one job (partitioned by tensor and mode)."""
        self.version += 1
        path = f"{self.root}/factors/{tag}/v{self.version:05d}"
        parts = [df.select(F.lit(t).alias("tensor"), F.lit(m).alias("mode"), "idx", "v")
                 for (t, m), df in frames.items()]
        union = parts[0]
        for p in parts[1:]:
            union = union.unionByName(p)
        self.put_table(union, list(frames), tag, path)

    def put_table(self, table: DataFrame, keys: list[FactorKey], tag: str, path: str | None = None) -> None:
        """Write a ``(tensor, mode, idx, v)`` table in one job and load each factor."""
        if path is None:
            self.version += 1
            path = f"{self.root}/factors/{tag}/v{self.version:05d}"
        watch = Observation()
        cells = [(f"tensor = {t} AND mode = {m}", c) for t, m in keys for c in range(self.rank)]
        sums = [F.count(F.lit(1)).alias("n")] + [F.expr(f"avg(CASE WHEN {mine} THEN v[{c}] END)").alias(f"m_{i}") for i, (mine, c) in enumerate(cells)]
        table.observe(watch, *sums).write.mode("overwrite").partitionBy("tensor", "mode").parquet(path)
        self._note(keys, watch.get)
        for (t, m) in keys:
            self.load((t, m), f"{path}/tensor={t}/mode={m}")

    def load(self, key: FactorKey, path: str) -> DataFrame:
        # Declared schema: no job to read footers back.
        df = self.spark.read.schema(FACTOR_SCHEMA).parquet(path)
        self.written.add(path)
        self.paths[key] = path
        self.frames[key] = df
        return df

    def forget(self, needed: Sequence[dict[FactorKey, str]]) -> None:
        """Delete the written versions that no snapshot in ``needed`` refers to."""
        keep = {path for paths in needed for path in paths.values()} | set(self.paths.values())
        for path in sorted(self.written - keep):
            _delete(self.spark, path)
            self.written.discard(path)

    def restore(self, paths: dict[FactorKey, str], version: int, written: Sequence[str],
                means: dict[FactorKey, list[float]]) -> None:
        """Take up the factors of a committed iteration; later versions of a killed run are written over."""
        for key, path in paths.items():
            self.load(key, path)
        self.means.update(means)
        self.version = version
        self.written.update(written)

    def snapshot(self) -> dict[FactorKey, str]:
        return dict(self.paths)


@dataclass
class Model:
    """A fitted model: factor tables, metrics, best validated versions."""

    spark: SparkSession
    rank: int
    common: int
    paths: dict[FactorKey, str]
    history: list[tuple[int, float, str, float]]
    final_iter: int
    checkpoints: dict[int, dict[FactorKey, str]] = field(default_factory=dict)
    best_validation: dict[int, tuple[int, float, dict[FactorKey, str]]] = field(default_factory=dict)
    root: str = ""
    timings: list[tuple[str, float]] = field(default_factory=list)
    versions: dict[int, dict[FactorKey, str]] = field(default_factory=dict)

    def factor(self, t: int, m: int) -> DataFrame:
        return self.spark.read.schema(FACTOR_SCHEMA).parquet(self.paths[(t, m)])

    def factors_of(self, t: int) -> dict[int, DataFrame]:
        return {m: self.factor(tt, m) for (tt, m) in sorted(self.paths) if tt == t}

    def factor_table(self, paths: dict[FactorKey, str] | None = None) -> DataFrame:
        """All factors as ``(tensor, mode, idx, v)``."""
        use = paths or self.paths
        out = None
        for (t, m), p in sorted(use.items()):
            df = copy_factor(self.spark.read.schema(FACTOR_SCHEMA).parquet(p), t, m)
            out = df if out is None else out.unionByName(df)
        return out

    def best_factor_table(self, t: int) -> DataFrame:
        """Factors of tensor ``t`` at its best validation RMSE."""
        _, _, paths = self.best_validation[t]
        return self.factor_table({k: v for k, v in paths.items() if k[0] == t})

    @property
    def metrics(self) -> DataFrame:
        rows = [(int(i), float(s), str(term), None if v is None else float(v))
                for i, s, term, v in self.history]
        return self.spark.createDataFrame(rows, METRICS_SCHEMA)


def _folder(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _delete(spark: SparkSession, path: str) -> None:
    system, target = _folder(spark, path)
    system.delete(target, True)


def _exists(spark: SparkSession, path: str) -> bool:
    system, target = _folder(spark, path)
    return bool(system.exists(target))


def _log(verbose: bool, msg: str) -> None:
    if verbose:
        print(f"[twinfold] {msg}", file=sys.stderr, flush=True)


def evaluate(spark: SparkSession, tensors: Sequence[Tensor], valid: Sequence[Tensor] | None,
             store: FactorStore, rank: int, heavy: Sequence[dict[int, DataFrame]] | None = None,
             measured: dict[int, FactorKey] | None = None, counts: Sequence[int] = (), squares: Sequence[float] = (),
             sums: dict[int, tuple[int, DataFrame]] | None = None) -> tuple[dict, dict, dict]:
    """Column means of every factor, SSE and count of every tensor; at most one job, without ``sums``.

    ``measured``: tensors whose last update of the sweep measured the error of all their entries, with the factor it
    wrote; their entries are not read again, unless the error is below ``LEAST_ERROR`` of the sum of their squares
    (``squares``). It is a difference of sums then, with hardly a digit left. The same holds for tensors with ``sums``
    (a mode and its sums at the present rows of the others).
    """
    train: dict[int, tuple[float, int]] = {}
    val: dict[int, tuple[float, int]] = {}
    for t, key in (measured or {}).items():
        if store.errors[key] > LEAST_ERROR * squares[t]:
            train[t] = (store.errors[key], int(counts[t]))

    def errors(which: Sequence[tuple[str, int, Tensor]], known: dict[int, tuple[int, DataFrame]]) -> list:
        union = None
        for prefix, t, ten in which:
            own = {(0, m): store.frames[(t, m)] for m in range(ten.n_modes)}
            hot = [heavy[t]] if heavy and prefix == "train" else None
            row = loss_table(spark, [ten], own, rank, prefix, hot, [known.get(t) if prefix == "train" else None]).withColumn("tensor", F.lit(t))
            union = row if union is None else union.unionByName(row)
        return union.collect() if union is not None else []

    due = [("train", t, ten) for t, ten in enumerate(tensors) if t not in train]
    known = {t: found for t, found in (sums or {}).items() if t not in (measured or {})}
    for r in errors(due + [("valid", t, ten) for t, ten in enumerate(valid or ())], known):
        (train if r.part == "train" else val)[r.tensor] = (float(r.sse or 0.0), int(r.n))
    lost = [(prefix, t, ten) for prefix, t, ten in due if t in known and not train[t][0] > LEAST_ERROR * squares[t]]
    for r in errors(lost, {}):
        train[r.tensor] = (float(r.sse or 0.0), int(r.n))
    return dict(store.means), train, val


def fit(spark: SparkSession, tensors: Sequence[Tensor], couplings: Sequence[Coupling],
        config: FitConfig | None = None, validation: Sequence[Tensor] | None = None,
        root: str | None = None, verbose: bool = False, metrics_path: str | None = None, resume: bool = False) -> Model:
    """Coupled factorisation of two or more tensors by alternating ridge least squares.

    ``couplings`` may join modes at any positions of tensors with any mode counts (see :mod:`twinfold.plans.layout`).
    ``metrics_path``: when set, each iteration's metric rows are appended
    there as parquet as soon as they are known (S5/S6), so the log survives
    a driver failure mid-fit. Iteration 0 starts the log anew, so a rerun to the
    same path does not mix two runs.

    ``resume``: go on from the last iteration committed under ``root`` (S8; :mod:`twinfold.plans.commits`), if there is
    one; what a killed run wrote after it is written again. The tensors, couplings and options must be those of the run
    that is resumed; the stopping rule may differ.
    """
    cfg = config or FitConfig()
    if resume and not root:
        raise ValueError("resuming needs the root of the fit to be resumed")
    if any(d < 1 for t in tensors for d in t.dims):
        raise ValueError("empty mode")
    graph = layout(tensors, couplings)
    root = root or run_dir(spark, "fit")
    timings: list[tuple[str, float]] = []
    mark = [time.time()]

    def lap(phase: str) -> None:
        now = time.time()
        timings.append((phase, now - mark[0]))
        mark[0] = now

    # One cached copy of the entries per mode (the reference keeps one slice per mode too), released however
    # the fit ends. Cached data is recomputable from its source if an executor is lost.
    held: list[DataFrame] = []
    tables: list[str] = []
    try:
        return _fit(spark, tensors, validation, graph, cfg, root, verbose, metrics_path, resume, lap, timings, held, tables)
    finally:
        for df in held:
            df.unpersist()
        for name in tables:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _bucketed_by(t: Tensor, large: Sequence[int]) -> list[int]:
    """Per mode, the mode whose buckets its copy of the entries lies in: the largest other mode whose factor is too large to
    broadcast, or the mode itself if only its own is."""
    return [max([k for k in large if k != m] or [m], key=lambda k: t.dims[k]) for m in range(t.n_modes)]


def _stored_before(spark: SparkSession, t: Tensor, n: int, by: Sequence[int], was: dict, tables: list[str]) -> dict[int, DataFrame] | None:
    """The copies of an earlier run, per mode they are bucketed by; None if one is no longer whole."""
    stored = {}
    for k in sorted(set(by)):
        path, buckets = was["stored"][str(k)]
        if not _exists(spark, path):
            return None
        tables.append(f"twinfold_{uuid.uuid4().hex}")
        stored[k] = stored_table(spark, k, t.n_modes, buckets, tables[-1], path)
        if stored[k].count() != n:
            return None
    return stored


def _layout(spark: SparkSession, t: Tensor, cfg: FitConfig, level: StorageLevel, held: list[DataFrame],
            root: str, tables: list[str], was: dict | None = None, note: dict | None = None,
            ) -> tuple[int, float, list[Tensor], dict[int, DataFrame]]:
    """Entries checked and counted once, then kept as one copy per mode.

    Where the other modes' factors can be broadcast, the copy is cached and range-partitioned on the mode's key. Otherwise it is
    written once, in buckets of the largest other mode, so that no update moves the entries to meet that factor; if only the
    mode's own factor is too large, in buckets of the mode itself, where they meet its rows and give its sums. Modes that
    ask for the same buckets share one copy.
    Heavy indices are measured only if some factor is too large to broadcast.

    ``note`` takes up what a resumed fit needs to find the written copies again: ``digest`` of the entries, ``stored`` (path and
    number of buckets per mode they are bucketed by) and ``heavy``. ``was``: such a note of the run that is resumed. If it is of
    the same entries, they are read once, to be checked, and its copies are taken.
    """
    src = t.entries.select(*entry_columns(t.n_modes))
    large = [m for m, d in enumerate(t.dims) if not fits_broadcast(spark, d, cfg.rank)]
    by = _bucketed_by(t, large)
    hashed = {k: buckets_for_hashing(t.dims[k], cfg.rank) for k in by}
    again = bool(large and was) and all(was["stored"].get(str(k), ["", 0])[1] >= hashed[k] for k in by)
    if not again:
        held.append(src.persist(level))
    n, squares, digest = check_and_digest(t.with_entries(src))
    note = {} if note is None else note
    if again and was["digest"] == digest:
        found = _stored_before(spark, t, n, by, was, tables)
        if found is not None:
            note.update(was)
            return n, squares, [t.with_entries(found[k]) for k in by], {int(m): heavy_table(spark, rows) for m, rows in was["heavy"].items()}
    if again:
        held.append(src.persist(level))
    note.update(digest=digest, stored={}, heavy={})
    per_mode, hot = [], {}
    if large:
        shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
        for m in range(t.n_modes):
            rows = heavy_indices(src, m, max(1, -(-n // shuffled)), HEAVY_BINS * shuffled).collect()
            note["heavy"][str(m)] = [[r.idx, r.salts] for r in rows]
            hot[m] = heavy_table(spark, note["heavy"][str(m)])
    stored: dict[int, DataFrame] = {}
    for m in range(t.n_modes):
        if large:
            k = by[m]
            if k not in stored:
                # A split of the cached copies would be a bound on the tasks that meet a large factor.
                buckets = max(cfg.split or 1, partitions_for(spark, n, t.n_modes, cfg.partition_bytes), hashed[k])
                tables.append(f"twinfold_{uuid.uuid4().hex}")
                path = f"{root}/entries/{tables[-1]}"
                stored[k] = store_entries(spark, src, k, t.n_modes, hot[k], buckets, tables[-1], path, sort=False)
                note["stored"][str(k)] = [path, buckets]
            e = stored[k]
        else:
            e = cluster_by_mode(src, m, t.n_modes, partitions_for(spark, n, t.n_modes, cfg.partition_bytes, cfg.split, t.dims[m]))
            held.append(e.persist(level))
            e.count()
        per_mode.append(t.with_entries(e))
    src.unpersist()
    return n, squares, per_mode, hot


def _sweep(tensors: Sequence[Tensor], graph: Layout, rank: int, common: int) -> list[list[FactorKey]]:
    """The updates of a sweep in their order, each as the factors it writes."""
    out: list[list[FactorKey]] = []
    for t, ten in enumerate(tensors):
        for m in range(ten.n_modes):
            group = graph.group((t, m))
            if group and common > 0 and group[0] == (t, m):
                out.append(list(group))
            if not group or common < rank:
                out.append([(t, m)])
    return out


def _summed(spark: SparkSession, tensors: Sequence[Tensor], graph: Layout, cfg: FitConfig, counts: Sequence[int]) -> set[FactorKey]:
    """Modes whose sums are written and kept (``normal.mode_sums``): their entries move to be summed, and the sums are no more
    than what would move for a second update. A coupled mode's are kept for all its tensors or for none."""
    if use_gram(cfg.rank, cfg.method):
        return set()

    def few(t: int, m: int) -> bool:
        return min(tensors[t].dims[m], counts[t]) * (len(sum_names(cfg.rank)) + 2) <= counts[t] * (cfg.rank + 2)

    out = set()
    for t, ten in enumerate(tensors):
        for m in range(ten.n_modes):
            group = graph.group((t, m)) or ((t, m),)
            moved = any(not fits_broadcast(spark, d, cfg.rank) for u, _ in group for d in tensors[u].dims)
            if moved and all(few(*key) for key in group):
                out.add((t, m))
    return out


def _fit(spark: SparkSession, tensors: Sequence[Tensor], validation: Sequence[Tensor] | None, graph: Layout,
         cfg: FitConfig, root: str, verbose: bool, metrics_path: str | None, resume: bool,
         lap: Callable[[str], None], timings: list[tuple[str, float]], held: list[DataFrame], tables: list[str]) -> Model:
    rank, common, opts = cfg.rank, cfg.common, cfg.options
    level = getattr(StorageLevel, cfg.storage)
    copies: list[list[Tensor]] = []
    counts: list[int] = []
    squares: list[float] = []
    heavy: list[dict[int, DataFrame]] = []
    notes: list[dict] = [{} for _ in tensors]
    before = commits.copies(spark, root) if resume else []
    for i, t in enumerate(tensors):
        n, square, per_mode, hot = _layout(spark, t, cfg, level, held, root, tables, before[i] if i < len(before) else None, notes[i])
        counts.append(n)
        squares.append(square)
        copies.append(per_mode)
        heavy.append(hot)
    if any(note["stored"] for note in notes) and notes != before:
        commits.note_copies(spark, root, notes)
    cached = [c[0] for c in copies]
    vcached: list[Tensor] | None = None
    if validation is not None:
        if len(validation) != len(tensors):
            raise ValueError("one validation tensor per tensor")
        vcached = []
        for v, t in zip(validation, tensors):
            if v.dims != t.dims:
                raise ValueError("validation tensor dims differ from the training tensor")
            e = v.entries.select(*entry_columns(v.n_modes)).persist(level)
            held.append(e)
            vt = v.with_entries(e)
            check(vt)
            vcached.append(vt)

    store = FactorStore(spark, root, rank)
    what = commits.fingerprint(tensors, graph, cfg, counts)
    state = commits.latest(spark, root, what) if resume else None
    digests = [note["digest"] for note in notes]
    lap("prepare")
    if state is None:
        # M1: initial factors, written together in one job.
        init = {}
        for t, ten in enumerate(cached):
            for m in range(ten.n_modes):
                first = (graph.group((t, m)) or [(t, m)])[0] if cfg.share_init else (t, m)
                init[(t, m)] = init_factor(spark, ten.dims[m], rank, cfg.init, *first, cfg.seed)
        store.put_many(init, "it00000")
        state = commits.State()
    else:
        store.restore(state.snapshots[state.it], state.version, state.written, state.means)
        # Sums of other entries, or deleted since, are taken anew.
        state.sums = {(t, m): (met, path) for (t, m), (met, path) in state.sums.items()
                      if state.digests[t:t + 1] == digests[t:t + 1] and _exists(spark, path)}
    state.digests = digests
    lap("init")
    _log(verbose, f"init done: entries {counts}")

    start = time.time() - state.seconds
    # Per tensor: the factor whose update is the last of the sweep to touch the tensor, if that update measured the error.
    measured: dict[int, FactorKey] = {}
    summed = _summed(spark, tensors, graph, cfg, counts)
    stale: list[str] = []

    def met_by(t: int, m: int) -> list[str]:
        return [store.paths[(t, k)] for k in range(cached[t].n_modes) if k != m]

    def sums_of(t: int, m: int) -> DataFrame | None:
        """The sums of a mode at the present rows of the other modes, taken only where one of those has changed; None where no
        sums are kept."""
        if (t, m) not in summed:
            return None
        met, had = met_by(t, m), state.sums.get((t, m))
        if had is None or had[0] != met:
            # A name of its own: no commit of an earlier run names it.
            path = f"{root}/sums/{uuid.uuid4().hex}"
            mode_sums(spark, copies[t][m], factors_of(t), m, rank, heavy[t]).write.parquet(path)
            stale.extend([had[1]] if had else [])
            state.sums[(t, m)] = (met, path)
        return spark.read.schema(sums_schema(rank)).parquet(state.sums[(t, m)][1])

    def sums_for_losses() -> dict[int, tuple[int, DataFrame]]:
        """Sums that give the errors of the tensors no update has measured: some that still hold, or those of the update that touches
        a tensor first in the next sweep, which takes them again."""
        first = {t: m for (t, m), (met, _) in state.sums.items() if met == met_by(t, m)}
        for written in _sweep(cached, graph, rank, common):
            for t, m in written:
                first.setdefault(t, m)
        return {t: (m, sums_of(t, m)) for t, m in sorted(first.items()) if t not in measured and (t, m) in summed}

    def step_metrics(it: int) -> None:
        means, train, val = evaluate(spark, cached, vcached, store, rank, heavy, measured, counts, squares, sums_for_losses())
        seconds = time.time() - start
        losses = [training_loss(*train[t], opts.loss) for t in range(len(cached))]
        mean_losses = [sum(mean_loss(means[a], means[b], opts.loss) for a, b in graph.pairs(k))
                       for k in range(len(graph.aligned))]
        ml = mean_losses[0] if mean_losses else 0.0
        total = sum(losses) + ml
        rows = [(f"se_{t}", v) for t, v in enumerate(losses)] + [("mean", ml)]
        rows += [(f"mean_m{graph.aligned[k][0][1]}", v) for k, v in enumerate(mean_losses[1:], 1) if graph.pairs(k)]
        rows.append(("total", total))
        state.snapshots[it] = store.snapshot()
        rel = (state.loss - total) / state.loss if state.loss else float("nan")
        state.it, state.seconds, state.loss, state.rel, state.means = it, seconds, total, rel, means
        note_checkpoint()
        # Best validated factors per tensor.
        for t, (sse, n) in sorted(val.items()):
            r = rmse(sse, n)
            rows.append((f"val_rmse_{t}", r))
            if t not in state.best or r < state.best[t][1]:
                state.best[t] = (it, r, state.snapshots[it])
        state.history += [(it, seconds, term, v) for term, v in rows]
        if cfg.keep_versions == "needed":
            # The model is this iteration or the one before; older versions stay only as checkpoints and best ones.
            for old in [i for i in state.snapshots if i < it - 1]:
                del state.snapshots[old]
        state.version, state.written = store.version, sorted(store.written)
        commits.commit(spark, root, what, state)
        if metrics_path:
            write_metrics([h for h in state.history if h[0] == it], "append" if it else "overwrite")
        _log(verbose, f"iter {it}: total {total:.6g} rel {rel:.3g} ({seconds:.1f}s)")
        # Only after the commit: the one before names what goes now.
        while stale:
            _delete(spark, stale.pop())
        if cfg.keep_versions == "needed":
            store.forget([*state.snapshots.values(), *state.checkpoints.values(), *(b[2] for b in state.best.values())])

    def note_checkpoint() -> None:
        # Factor checkpoints every k iterations; the last one only if the loss fell.
        stop = cfg.stop.reached(state.it, state.seconds, state.rel)
        if (not stop and state.it % cfg.checkpoint_every == 0) or (stop and state.rel > 0):
            state.checkpoints[state.it] = state.snapshots[state.it]

    def write_metrics(rows: list[tuple], mode: str) -> None:
        spark.createDataFrame([(int(i), float(sec), term, None if v is None else float(v)) for i, sec, term, v in rows],
                              METRICS_SCHEMA).coalesce(1).write.mode(mode).parquet(metrics_path)

    def factors_of(t: int) -> dict[int, DataFrame]:
        return {k: store.frames[(t, k)] for k in range(cached[t].n_modes)}

    if state.it < 0:
        step_metrics(0)
        lap("loss_0")
    else:
        # The iteration that ended the resumed run may be one like any other now.
        note_checkpoint()
        if metrics_path:
            write_metrics(state.history, "overwrite")
    # M9: stopping rule (relative decrease, iterations, hours).
    while not cfg.stop.reached(state.it, state.seconds, state.rel):
        it, means = state.it + 1, state.means
        tag = f"it{it:05d}"
        # M7: Gauss-Seidel sweep, tensors then modes in order.
        measured.clear()
        for t, ten in enumerate(cached):
            for m in range(ten.n_modes):
                last = m == ten.n_modes - 1
                group = graph.group((t, m))
                if group:
                    if common > 0 and group[0] == (t, m):
                        sides = [Side(copies[u][k], factors_of(u), k, counts[u], (u, k), heavy[u], sums_of(u, k)) for u, k in group]
                        store.put_table(update_shared(spark, sides, rank, common, opts, cfg.method), list(group), tag)
                    if common < rank:
                        new = update_specific(spark, copies[t][m], factors_of(t), m, rank, common, opts, counts[t],
                                              cfg.method, heavy[t], last, sums=sums_of(t, m))
                        store.put((t, m), new, tag)
                        if last:
                            measured[t] = (t, m)
                else:
                    others = graph.pulled_by((t, m))
                    pull = [sum(means[o][c] for o in others) / len(others) for c in range(rank)] if others else None
                    new = update_uncoupled(spark, copies[t][m], factors_of(t), m, rank, opts, counts[t], means[(t, m)], pull,
                                           cfg.method, heavy[t], last, len(others), sums=sums_of(t, m))
                    store.put((t, m), new, tag)
                    if last:
                        measured[t] = (t, m)
        lap(f"sweep_{it}")
        step_metrics(it)
        lap(f"loss_{it}")

    final = state.it if state.it == 0 or state.rel > 0 else state.it - 1
    return Model(spark, rank, common, state.snapshots[final], state.history, final, state.checkpoints, state.best, root, timings,
                 dict(state.snapshots))
