"""Which factors share a block and which are pulled together: the coupling map as a graph.

The nodes are (tensor, mode); every coupling is an edge. Modes in one connected component are one domain and share the
first ``common`` columns of their factors, whatever their positions and however many tensors meet there. The other modes
are aligned by order: the k-th uncoupled modes of all tensors are pulled towards each other's column means.

The graph has a node per mode of a tensor, so it is planned on the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from twinfold.spec import Coupling, Tensor

FactorKey = tuple[int, int]


@dataclass(frozen=True)
class Layout:
    """``groups``: components of two or more modes, each in order of tensors; ``aligned``: k-th uncoupled modes per k."""

    groups: tuple[tuple[FactorKey, ...], ...]
    aligned: tuple[tuple[FactorKey, ...], ...]

    def group(self, key: FactorKey) -> tuple[FactorKey, ...] | None:
        """The component of a coupled mode, None for an uncoupled one."""
        return next((g for g in self.groups if key in g), None)

    def pulled_by(self, key: FactorKey) -> list[FactorKey]:
        """The factors whose means an uncoupled mode is matched with."""
        return [other for a in self.aligned if key in a for other in a if other != key]

    def pairs(self, k: int) -> list[tuple[FactorKey, FactorKey]]:
        """All pairs of the k-th uncoupled modes: the terms of the mean loss."""
        return list(combinations(self.aligned[k], 2)) if k < len(self.aligned) else []


def _root(above: dict[FactorKey, FactorKey], key: FactorKey) -> FactorKey:
    while above[key] != key:
        key = above[key]
    return key


def layout(tensors: Sequence[Tensor], couplings: Sequence[Coupling]) -> Layout:
    """The graph of ``couplings`` over ``tensors``; a ValueError says what cannot be coupled.

    Refused: fewer than two tensors, a mode that does not exist, modes of different size, two modes of one tensor in one
    component (their product is not linear in the shared block), and tensors that no chain of couplings connects.
    """
    if len(tensors) < 2:
        raise ValueError("the coupled fit takes at least two tensors (a single data set is refused)")
    if not couplings:
        raise ValueError("the coupled fit takes at least one coupled pair of modes")
    above = {(t, m): (t, m) for t, ten in enumerate(tensors) for m in range(ten.n_modes)}
    for c in couplings:
        for key in ((c.t1, c.m1), (c.t2, c.m2)):
            if key not in above:
                raise ValueError(f"the coupling names mode {key[1]} of tensor {key[0]}, which does not exist")
        a, b = sorted((_root(above, (c.t1, c.m1)), _root(above, (c.t2, c.m2))))
        above[b] = a
    parts: dict[FactorKey, list[FactorKey]] = {}
    for key in sorted(above):
        parts.setdefault(_root(above, key), []).append(key)
    groups = tuple(tuple(p) for p in parts.values() if len(p) > 1)
    joined = list(range(len(tensors)))
    for g in groups:
        if len({t for t, _ in g}) < len(g):
            raise ValueError(f"modes {[f'{t}_{m}' for t, m in g]} couple two modes of one tensor")
        if len({tensors[t].dims[m] for t, m in g}) > 1:
            raise ValueError(f"coupled modes must have the same size: {[(f'{t}_{m}', tensors[t].dims[m]) for t, m in g]}")
        least = min(joined[t] for t, _ in g)
        merged = {joined[t] for t, _ in g}
        joined = [least if j in merged else j for j in joined]
    if set(joined) != {0}:
        raise ValueError(f"tensors {[t for t, j in enumerate(joined) if j]} are not coupled with tensor 0; fit them apart")
    coupled = {key for g in groups for key in g}
    free = [[(t, m) for m in range(ten.n_modes) if (t, m) not in coupled] for t, ten in enumerate(tensors)]
    aligned = tuple(tuple(f[k] for f in free if len(f) > k) for k in range(max(len(f) for f in free)))
    return Layout(groups, aligned)
