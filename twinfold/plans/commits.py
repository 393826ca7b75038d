"""Commits of a fit: one row per finished iteration, from which a later run goes on.

A commit names the factor versions of the iteration, all of them written before it, and holds the scalars of the loop. It is
one row in one file of its iteration's own folder, renamed into place by Spark's committer: a killed run leaves all of it or
nothing that is read, and the next run overwrites the folder. Versions that a killed run wrote after its last commit are
named by no commit and are written again under the same paths.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twinfold.plans.layout import FactorKey, Layout
from twinfold.spec import FitConfig, Tensor

SCHEMA = "iter int, fit string, state string"


@dataclass
class State:
    """Where a fit stands after iteration ``it`` (-1: factors are initialised, nothing is measured yet)."""

    it: int = -1
    seconds: float = 0.0
    loss: float = 1.0e80
    rel: float = float("nan")
    version: int = 0
    means: dict[FactorKey, list[float]] = field(default_factory=dict)
    history: list[tuple[int, float, str, float]] = field(default_factory=list)
    snapshots: dict[int, dict[FactorKey, str]] = field(default_factory=dict)
    checkpoints: dict[int, dict[FactorKey, str]] = field(default_factory=dict)
    best: dict[int, tuple[int, float, dict[FactorKey, str]]] = field(default_factory=dict)
    written: list[str] = field(default_factory=list)
    # Per mode: the factors of the other modes at which its sums were taken, and where they lie.
    sums: dict[FactorKey, tuple[list[str], str]] = field(default_factory=dict)
    digests: list[str] = field(default_factory=list)


def fingerprint(tensors: Sequence[Tensor], graph: Layout, cfg: FitConfig, counts: Sequence[int]) -> str:
    """What must be the same for a fit to be resumed; the stopping rule and the physical options are left out."""
    return json.dumps({"dims": [t.dims for t in tensors], "entries": list(counts), "groups": graph.groups, "rank": cfg.rank,
                       "common": cfg.common, "lam": cfg.options.lam, "loss": cfg.options.loss, "init": cfg.init,
                       "seed": cfg.seed, "share_init": cfg.share_init})


def _flat(paths: dict[FactorKey, str]) -> list:
    return [[t, m, p] for (t, m), p in sorted(paths.items())]


def _keyed(rows: list) -> dict[FactorKey, str]:
    return {(t, m): p for t, m, p in rows}


def _text(state: State) -> str:
    # Floats are written so that they read back the same, NaN and infinities included.
    return json.dumps(state.__dict__ | {
        "means": [[t, m, v] for (t, m), v in sorted(state.means.items())],
        "snapshots": [[i, _flat(p)] for i, p in state.snapshots.items()],
        "checkpoints": [[i, _flat(p)] for i, p in state.checkpoints.items()],
        "best": [[t, i, r, _flat(p)] for t, (i, r, p) in state.best.items()],
        "sums": [[t, m, met, path] for (t, m), (met, path) in sorted(state.sums.items())]})


def _state(text: str) -> State:
    raw = json.loads(text)
    return State(**raw | {
        "means": {(t, m): v for t, m, v in raw["means"]}, "history": [tuple(h) for h in raw["history"]],
        "snapshots": {i: _keyed(p) for i, p in raw["snapshots"]}, "checkpoints": {i: _keyed(p) for i, p in raw["checkpoints"]},
        "best": {t: (i, r, _keyed(p)) for t, i, r, p in raw["best"]},
        "sums": {(t, m): (met, path) for t, m, met, path in raw.get("sums", [])}})


def commit(spark: SparkSession, root: str, what: str, state: State) -> None:
    """Append the state of a finished iteration; iteration 0 starts anew."""
    row = spark.createDataFrame([(state.it, what, _text(state))], SCHEMA).coalesce(1)
    if state.it:
        row.write.mode("overwrite").parquet(f"{root}/commits/it={state.it}")
    else:
        row.withColumn("it", F.lit(0)).write.mode("overwrite").partitionBy("it").parquet(f"{root}/commits")


def table(spark: SparkSession, root: str) -> DataFrame:
    """``iter, fit, state`` of the commits under ``root``."""
    return spark.read.schema(SCHEMA).parquet(f"{root}/commits").select("iter", "fit", "state")


def latest(spark: SparkSession, root: str, what: str) -> State | None:
    """The last committed state under ``root``, None if there is no commit; a fit of other data or options is refused."""
    try:
        row = table(spark, root).orderBy(F.col("iter").desc()).first()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return None
        raise
    if row is None:
        return None
    if row.fit != what:
        raise ValueError(f"the fit under {root} is another one: {row.fit}, not {what}")
    return _state(row.state)


def note_copies(spark: SparkSession, root: str, copies: list[dict]) -> None:
    """Write down which stored copies of the entries lie under ``root``: one dict per tensor (see ``fit._layout``)."""
    spark.createDataFrame([(json.dumps(copies),)], "copies string").coalesce(1).write.mode("overwrite").parquet(f"{root}/copies")


def copies(spark: SparkSession, root: str) -> list[dict]:
    """What :func:`note_copies` wrote last under ``root``; nothing if it did not get that far."""
    try:
        row = spark.read.schema("copies string").parquet(f"{root}/copies").first()
    except Exception as missing:
        if "PATH_NOT_FOUND" in str(missing):
            return []
        raise
    return json.loads(row.copies) if row is not None else []
