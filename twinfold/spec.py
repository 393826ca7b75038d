"""Small value objects: tensors, couplings, options, stopping rule."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from twinfold.functions.columns import entry_columns


@dataclass(frozen=True)
class Tensor:
    """A sparse tensor in COO form: columns ``i0 .. i{N-1}`` (long) and ``y`` (double).

    ``dims`` is the declared size of every mode. Every index must lie in
    ``[0, dims[m])``; a missing cell is an absent row, an explicit 0 is an
    observation, and duplicate coordinates are separate observations.
    """

    entries: DataFrame
    dims: tuple[int, ...]
    name: str = ""

    def __post_init__(self) -> None:
        if len(self.dims) < 2:
            raise ValueError("a tensor needs at least two modes")
        missing = [c for c in entry_columns(len(self.dims)) if c not in self.entries.columns]
        if missing:
            raise ValueError(f"tensor {self.name or ''} lacks columns {missing}")

    @property
    def n_modes(self) -> int:
        return len(self.dims)

    def with_entries(self, entries: DataFrame) -> Tensor:
        return Tensor(entries, self.dims, self.name)


@dataclass(frozen=True)
class Coupling:
    """Mode ``m1`` of tensor ``t1`` is the same domain as mode ``m2`` of tensor ``t2``."""

    t1: int
    m1: int
    t2: int
    m2: int
    pair: int = 0

    def partner(self, t: int, m: int) -> tuple[int, int] | None:
        if (t, m) == (self.t1, self.m1):
            return self.t2, self.m2
        if (t, m) == (self.t2, self.m2):
            return self.t1, self.m1
        return None

    @staticmethod
    def parse(left: str, right: str, pair: int = 0) -> Coupling:
        """From the ``t_m`` notation, e.g. ``Coupling.parse("0_1", "1_1")``."""
        a, b = left.split("_"), right.split("_")
        return Coupling(int(a[0]), int(a[1]), int(b[0]), int(b[1]), pair)


@dataclass(frozen=True)
class Stop:
    """Stopping rule; any mix of the three conditions, at least one."""

    min_rel_decrease: float | None = None
    max_iter: int | None = None
    max_hours: float | None = None

    def __post_init__(self) -> None:
        if not (self.min_rel_decrease or self.max_iter or self.max_hours):
            raise ValueError("set at least one stopping condition")

    def reached(self, it: int, seconds: float, rel: float) -> bool:
        """Whether the fit ends at iteration ``it``, after ``seconds``, with a relative decrease ``rel`` of the loss (M9).

        A decrease that is not finite (a loss that is NaN or infinite) ends it like one that is too small.
        """
        if self.min_rel_decrease and not (math.isfinite(rel) and rel >= self.min_rel_decrease):
            return True
        if self.max_hours and seconds / 3600.0 > self.max_hours:
            return True
        return bool(self.max_iter and it >= self.max_iter)

    @staticmethod
    def parse(text: str) -> Stop:
        """``"0_1e-4_1_50_2_3"``: code 0 = min relative decrease, 1 = max iterations, 2 = max hours."""
        parts = text.split("_")
        if len(parts) % 2:
            raise ValueError(f"bad stopping condition {text!r}")
        kw: dict[str, float | int] = {}
        for code, val in zip(parts[0::2], parts[1::2]):
            if code == "0":
                kw["min_rel_decrease"] = float(val)
            elif code == "1":
                kw["max_iter"] = int(val)
            elif code == "2":
                kw["max_hours"] = float(val)
            else:
                raise ValueError(f"unknown stopping code {code!r} in {text!r}")
        return Stop(**kw)


@dataclass(frozen=True)
class Options:
    """Closed-form ridge ALS options: ``lam`` on the diagonal, ``loss`` ls or wls."""

    lam: float = 0.1
    loss: str = "ls"

    def __post_init__(self) -> None:
        if self.loss not in ("ls", "wls"):
            raise ValueError("loss must be 'ls' or 'wls'")
        if self.lam < 0:
            raise ValueError("lam must be >= 0")

    @staticmethod
    def parse(text: str) -> Options:
        """``"CF_0.1_LS"`` or ``"CF_0.1_WLS"``."""
        parts = text.split("_")
        if len(parts) != 3 or parts[0] != "CF" or parts[2] not in ("LS", "WLS"):
            raise ValueError(f"optimiser must look like CF_<lambda>_<LS|WLS>, got {text!r}")
        return Options(float(parts[1]), parts[2].lower())


STORAGE_LEVELS = ("MEMORY_ONLY", "MEMORY_AND_DISK", "DISK_ONLY", "MEMORY_ONLY_2", "MEMORY_AND_DISK_2", "DISK_ONLY_2")


@dataclass
class FitConfig:
    """``partition_bytes``: size of a cached partition of entries; ``split``: instead, at most so many partitions
    per mode (never more than the mode has indices); ``storage``: level of the cached entries; ``keep_versions``:
    ``needed`` deletes factor versions that no checkpoint, best or last-two snapshot refers to.
    """

    rank: int = 5
    common: int = 3
    options: Options = field(default_factory=Options)
    stop: Stop = field(default_factory=lambda: Stop(min_rel_decrease=1e-4, max_iter=100))
    init: str = "random"
    seed: int = 0
    checkpoint_every: int = 1
    share_init: bool = False
    partition_bytes: int = 256 << 20
    split: int | None = None
    method: str = "auto"
    storage: str = "MEMORY_AND_DISK"
    keep_versions: str = "needed"

    def __post_init__(self) -> None:
        if self.rank < 1:
            raise ValueError("rank must be >= 1")
        if not 0 <= self.common <= self.rank:
            raise ValueError("common must be in [0, rank]")
        if self.method not in ("auto", "sum", "gram"):
            raise ValueError("method must be 'auto', 'sum' or 'gram'")
        if self.storage not in STORAGE_LEVELS:
            raise ValueError(f"storage must be one of {STORAGE_LEVELS}")
        if self.keep_versions not in ("needed", "all"):
            raise ValueError("keep_versions must be 'needed' or 'all'")
        if self.partition_bytes < 1 or (self.split is not None and self.split < 1):
            raise ValueError("partition_bytes and split must be positive")
        if self.checkpoint_every < 1:
            raise ValueError("checkpoint_every must be >= 1")
