"""Session helpers: checkpoint folder, broadcast size checks, run folders."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Bytes per factor row beyond its doubles (idx, array header, row overhead).
_ROW_OVERHEAD = 48
# Upper bound on what we broadcast ourselves, whatever the session threshold.
MAX_BROADCAST_BYTES = 256 * 1024 * 1024


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for lineage cuts and per-update factor tables.

    Reads ``spark.checkpoint.dir`` from the session. Only a session whose
    driver and executors are one process (``local``, ``local[n]``: tests, the
    smoke check) gets a folder of its own when it is unset. Any other session without
    it is an error, since a machine-local folder would not survive the loss of an executor.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        master = conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        path = tempfile.mkdtemp(prefix="twinfold-ckpt-")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def run_dir(spark: SparkSession, label: str = "run") -> str:
    """A fresh folder under the checkpoint folder for one fit or export."""
    return f"{checkpoint_dir(spark)}/twinfold/{label}-{uuid.uuid4().hex[:12]}"


def broadcast_limit(spark: SparkSession) -> int:
    """Session broadcast threshold in bytes, capped by ``spark.twinfold.maxBroadcastBytes`` and MAX_BROADCAST_BYTES."""
    own = int(spark.conf.get("spark.twinfold.maxBroadcastBytes", str(MAX_BROADCAST_BYTES)))
    raw = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    try:
        limit = _parse_bytes(raw)
    except ValueError:
        limit = 10 * 1024 * 1024
    if limit < 0:
        return 0
    return min(limit, own, MAX_BROADCAST_BYTES)


def factor_bytes(dim: int, width: int) -> int:
    """Size bound of a factor table with ``dim`` rows of ``width`` doubles."""
    return int(dim) * (8 * int(width) + _ROW_OVERHEAD)


def fits_broadcast(spark: SparkSession, dim: int, width: int) -> bool:
    """True when a factor of ``dim`` rows of ``width`` doubles may be broadcast.

    ``dim`` is the declared number of rows (a factor has exactly one row per index), so the bound is proven rather
    than estimated. Larger factors go through a salted shuffle join.
    """
    return factor_bytes(dim, width) <= broadcast_limit(spark)


def splits_hot_keys(spark: SparkSession) -> bool:
    """True when Spark itself splits the hot partitions of a sort-merge join and of a rebalance as it runs (AQE)."""
    names = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled",
             "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled")
    return all(str(spark.conf.get(n, "true")).lower() == "true" for n in names)


def _parse_bytes(raw: str) -> int:
    s = str(raw).strip().lower()
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30, "t": 1 << 40, "tb": 1 << 40}
    for suffix in sorted(units, key=len, reverse=True):
        if s.endswith(suffix) and s[: -len(suffix)].strip().lstrip("-").isdigit():
            return int(s[: -len(suffix)].strip()) * units[suffix]
    return int(s)


def local_session(app: str = "twinfold", cores: int | None = None, shuffle_partitions: int = 8) -> SparkSession:
    """Session used by tests, bench and the job when run locally."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("TWINFOLD_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
