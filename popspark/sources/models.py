"""Model files: mutation and recombination, demographies with wildcards, growth rates. All are small texts."""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

import numpy as np

Cell = float | int
#: Epochs are at least this long, and populations at least this large.
SHORTEST = 1e-4


@dataclass(frozen=True)
class Params:
    """Rates of mutation and recombination, and which alleles become which. ``thetas``, if given, are the mutation rates in each
    hidden interval, and theta is that of where intervals do not matter."""

    theta: float
    rho: float
    matrix: np.ndarray
    thetas: tuple[float, ...] = ()

    def in_intervals(self, n: int) -> np.ndarray:
        """The mutation rate in each of n hidden intervals."""
        if self.thetas and len(self.thetas) != n:
            raise ValueError(f"there are {len(self.thetas)} mutation rates for {n} hidden intervals")
        return np.array(self.thetas or (self.theta,) * n, float)

    def mutated(self, t: float, bounds: list[float]) -> float:
        """The mutation rate added up from now to a time t ago."""
        ends = np.minimum(np.array(bounds[1:]), t)
        return float((np.maximum(ends - np.array(bounds[:-1]), 0) * self.in_intervals(len(bounds) - 1)).sum())


def _lines(text: str) -> list[str]:
    return [x.strip() for x in text.splitlines() if x.strip() and not x.startswith("#")]


def parse_params(text: str, renormalize: bool = True) -> Params:
    """Mutation rate, recombination rate, and the rows of the mutation matrix."""
    theta, rho, *rows = _lines(text)
    matrix = np.array([[float(x) for x in r.split()] for r in rows])
    if matrix.ndim != 2 or matrix.shape[0] != matrix.shape[1] or (matrix < 0).any():
        raise ValueError("the mutation matrix is not square, or has a negative entry")
    if renormalize:
        matrix = matrix / matrix.sum(1, keepdims=True)
    if abs(matrix.sum(1) - 1).max() > 1e-12:
        raise ValueError("a row of the mutation matrix does not add up to one")
    return Params(float(theta), float(rho), matrix)


def uniform(matrix: np.ndarray, epsilon: float = 1e-12) -> bool:
    """Whether each allele changes into every other one alike."""
    k = len(matrix)
    return k < 2 or bool(abs(matrix - (1 - np.eye(k)) / (k - 1)).max() < epsilon)


@dataclass(frozen=True)
class Wild:
    """A parameter that a point fills in."""

    index: int


@dataclass(frozen=True)
class Epoch:
    """start and end; the demes of each ancient deme; sizes at the ancient end; migration, pulse (of no duration) and growth rates."""

    start: float | Wild
    end: float | Wild
    partition: tuple[frozenset[int], ...]
    sizes: tuple[float | Wild, ...] = ()
    migration: tuple[tuple[float | Wild, ...], ...] = ()
    pulse: tuple[tuple[float | Wild, ...], ...] | None = None
    growth: tuple[float | Wild, ...] = ()


@dataclass(frozen=True)
class Template:
    epochs: tuple[Epoch, ...]

    @property
    def dimension(self) -> int:
        found = {w.index for w in _wilds(self)}
        if found != set(range(len(found))):
            raise ValueError("the wildcards are not numbered from 0 without gaps")
        return len(found)


def _cell(x: str) -> float | Wild:
    return Wild(int(x[1:])) if x.startswith("?") else float(x)


def _wilds(x: object) -> list[Wild]:
    if isinstance(x, Wild):
        return [x]
    if isinstance(x, Template):
        return _wilds(x.epochs)
    if isinstance(x, Epoch):
        return _wilds((x.start, x.end, x.sizes, x.migration, x.pulse or (), x.growth))
    return [w for y in x for w in _wilds(y)] if isinstance(x, tuple) else []


def _row(line: str) -> tuple[float | Wild, ...]:
    return tuple(_cell(x) for x in line.split())


def parse_demography(text: str, rates: str | None = None) -> Template:
    """Boundaries, then for each epoch its demes, sizes, pulse (or null) and migration rows. A pulse is an epoch of its own,
    without length, before the one that it stands in."""
    lines = iter(_lines(text))
    times = [_cell(x) for x in next(lines).strip("[] ").replace(",", " ").split()]
    bounds: list[float | Wild] = [0.0, *times, float("inf")]
    growth = iter(_lines(rates)) if rates else None
    epochs: list[Epoch] = []
    for start, end in zip(bounds[:-1], bounds[1:], strict=True):
        partition = tuple(frozenset(map(int, x.split(","))) for x in re.findall(r"\{([0-9, ]+)\}", next(lines)))
        sizes = _row(next(lines))
        first = next(lines)
        if len(sizes) != len(partition):
            raise ValueError("an epoch has a size for each of its demes")
        if first != "null":
            epochs.append(Epoch(start, start, partition, pulse=(_row(first), *(_row(next(lines)) for _ in partition[1:]))))
        migration = tuple(_row(next(lines)) for _ in partition)
        rate = _row(next(growth)) if growth else (0.0,) * len(partition)
        epochs.append(Epoch(start, end, partition, sizes, migration, growth=rate))
    for young, old in zip(epochs[:-1], epochs[1:], strict=True):
        if any(sum(p <= q for q in old.partition) != 1 for p in young.partition):
            raise ValueError("each deme goes into exactly one deme of the epoch before it in time")
    return Template(tuple(epochs))


def bound(template: Template, point: list[float], limits: list[tuple[float, float]] | None = None, halve_migration: bool = False) -> tuple[Epoch, ...] | None:
    """The epochs with the point's values, migration's diagonal minus the row's sum and pulses' one minus it; None where the
    point is outside its limits or makes no demography."""
    if limits and any(not low <= x <= high for x, (low, high) in zip(point, limits, strict=True)):
        return None

    def value(x: object) -> object:
        return point[x.index] if isinstance(x, Wild) else tuple(map(value, x)) if isinstance(x, tuple) else x

    out = []
    for e in template.epochs:
        start, end = value(e.start), value(e.end)
        if e.pulse is None and (not end - start > SHORTEST or min(value(e.sizes)) <= SHORTEST):
            return None
        if e.pulse is None and end == float("inf") and any(value(e.growth)):
            return None
        migration = np.array(value(e.migration), float) * (0.5 if halve_migration else 1) if e.migration else None
        pulse = np.array(value(e.pulse), float) if e.pulse else None
        for m, whole in ((migration, 0.0), (pulse, 1.0)):
            if m is not None:
                np.fill_diagonal(m, 0)
                if (m < 0).any() or whole and (m.sum(1) > 1).any():
                    return None
                np.fill_diagonal(m, whole - m.sum(1))
        out.append(replace(e, start=start, end=end, sizes=value(e.sizes), growth=value(e.growth), migration=tuple(map(tuple, migration)) if migration is not None else (), pulse=tuple(map(tuple, pulse)) if pulse is not None else None))
    if any(young.end != old.start for young, old in zip(out[:-1], out[1:], strict=True)):
        return None
    return tuple(out)


def with_least_migration(template: Template, params: Params, factor: float = 0.005) -> Template:
    """Fixed off-diagonal rates below factor times the smallest of theta, rho and all fixed rates above zero are raised to it,
    zeros included; wildcards stay."""
    fixed = [x for e in template.epochs for i, r in enumerate(e.migration) for j, x in enumerate(r) if i != j and not isinstance(x, Wild) and x > 0]
    least = factor * min([params.theta, params.rho, *fixed])
    lift = lambda i, j, x: x if i == j or isinstance(x, Wild) else max(x, least)
    return Template(tuple(replace(e, migration=tuple(tuple(lift(i, j, x) for j, x in enumerate(r)) for i, r in enumerate(e.migration))) for e in template.epochs))
