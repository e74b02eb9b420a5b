"""Hidden intervals of coalescence time: boundaries that begin with 0 and end with infinity."""

from __future__ import annotations

import numpy as np

from popspark.sources.models import Epoch

INF = float("inf")


def log_uniform(numbers: list[float]) -> list[float]:
    """m counts and m + 1 points: each range between points in as many log-spaced pieces; before and after, one piece each."""
    m = (len(numbers) - 1) // 2
    counts, points = [int(x) for x in numbers[:m]], numbers[m:]
    if len(points) != m + 1:
        raise ValueError("m counts need m + 1 points")
    inner = [(a * (b / a) ** (np.arange(n) / n)).tolist() for n, a, b in zip(counts, points[:-1], points[1:], strict=True)]
    return [0.0, *(x for part in inner for x in part), points[-1], INF]


def balanced(n: int, rate: float) -> list[float]:
    """Pieces of equal probability under an exponential law."""
    return [0.0, *(-np.log1p(-np.arange(1, n) / n) / rate).tolist(), INF]


def gauss_laguerre(n: int) -> list[float]:
    """Pieces whose probabilities under Exp(1) are the Gauss-Laguerre weights."""
    weights = np.polynomial.laguerre.laggauss(n)[1]
    return [0.0, *(-np.log1p(-np.cumsum(weights)[:-1])).tolist(), INF]


def _rates(e: Epoch, trunk: np.ndarray) -> list[float]:
    """At which rate the trunk's haplotypes absorb a lineage of each deme of an epoch."""
    return [sum(trunk[d] for d in group) / size for group, size in zip(e.partition, e.sizes, strict=True)]


def mean_rate(n: int, epochs: tuple[Epoch, ...], trunk: np.ndarray) -> list[float]:
    """Quantiles of the law whose rate is, in each epoch, the mean of its demes' absorption rates."""
    goals, out, reached = balanced(n, 1.0)[1:-1], [0.0], 0.0
    for e in (e for e in epochs if e.pulse is None):
        rate = float(np.mean(_rates(e, trunk)))
        while len(out) - 1 < len(goals):
            t = e.start + (goals[len(out) - 1] - reached) / rate
            if t > e.end:
                break
            out.append(t)
        reached += (e.end - e.start) * rate
    return [*out, INF]


def mixture_uniform(n: int, epochs: tuple[Epoch, ...], trunk: np.ndarray) -> list[float]:
    """Pieces of equal mass, each piece's mass being that of what is left; in an epoch, lineages are spread evenly over the
    demes that can absorb them."""
    out, left = [0.0], 1.0 / n
    for e in (e for e in epochs if e.pulse is None):
        now, rates = e.start, np.array([r for r in _rates(e, trunk) if r > 1e-12])
        if not len(rates):
            continue
        survive = lambda t, rates=rates: float(np.exp(-rates * t).mean())
        while len(out) < n:
            if e.end < INF and survive(e.end - now) > 1 - left:
                left -= 1 - survive(e.end - now)
                break
            low, high = 0.0, 1.0
            while survive(high) > 1 - left:
                high *= 2
            for _ in range(200):
                low, high = ((low + high) / 2, high) if survive((low + high) / 2) > 1 - left else (low, (low + high) / 2)
            now += high
            out.append(now)
            left = 1.0 / (n - len(out) + 1)
    return [*out, INF]


def old(n: int, epochs: tuple[Epoch, ...], trunk: np.ndarray) -> list[float]:
    """The epochs, cut at n quantiles of an exponential law whose mean is that of the youngest epoch's demes."""
    first = epochs[0]
    mean = 0.0
    for d in range(len(first.partition)):
        if trunk[d]:
            mean += first.sizes[d] / trunk[d]
        elif first.migration[d][d]:
            mean -= 1 / (2 * first.migration[d][d])
    return union([balanced(n + 1, len(first.partition) / mean), epoch_bounds(epochs)])


def epoch_bounds(epochs: tuple[Epoch, ...]) -> list[float]:
    return [*sorted({e.start for e in epochs if e.pulse is None}), INF]


def union(sets: list[list[float]], epsilon: float = 1e-10) -> list[float]:
    """All boundaries of several sets, those within epsilon of the one before being one."""
    out: list[float] = []
    for x in sorted({x for s in sets for x in s}):
        if not out or x - out[-1] > epsilon:
            out.append(x)
    return out


def quadrature(n: int, size: float, epochs: tuple[Epoch, ...], trunk: np.ndarray, rescaled: bool) -> list[float]:
    """Gauss-Laguerre pieces, each as much shorter as the lineages at its beginning are more than one. These are counted in
    a population of size 1, or with ``rescaled`` in one whose size is that of the epochs, which have one deme then."""
    from popspark.model.coalescent import mean_lineages

    def clock(t: float) -> float:
        if not rescaled:
            return t
        if any(len(e.sizes) != 1 for e in epochs if e.pulse is None):
            raise ValueError("quadrature2 is for one population")
        return sum((min(t, e.end) - e.start) / e.sizes[0] for e in epochs if e.pulse is None and e.start < t)

    out, points = [0.0], gauss_laguerre(n)
    for a, b in zip(points[:-2], points[1:-1], strict=True):
        out.append(out[-1] + (b - a) * size / mean_lineages(max(1, int(trunk.sum())), clock(out[-1])))
    return [*out, INF]


def boundaries(kind: str, numbers: list[float] | str, epochs: tuple[Epoch, ...], trunk: np.ndarray | None = None, deme: int = 0) -> list[float]:
    """By name, in any case: single, simple (the epochs), loguniform, custom (points, over the trunk's size in the deme),
    customfixed (points), fixeduniform (n, size), meanrate (n), mixtureuniform (n), old (n), balanced (n, rate), quadrature
    and quadrature2 (n, size), combined (name:numbers/name:numbers/...)."""
    trunk = np.ones(1, int) if trunk is None else trunk
    kind = kind.lower()
    if kind == "combined":
        parts = [p.split(":") for p in str(numbers).split("/")]
        return union([boundaries(name, [float(x) for x in rest.split(",") if x], epochs, trunk, deme) for name, rest in parts])
    values = [float(x) for x in numbers.split(",") if x] if isinstance(numbers, str) else numbers
    here = max(1.0, float(trunk[deme])) if deme < len(trunk) else 1.0
    match kind:
        case "single":
            return [0.0, INF]
        case "simple":
            return epoch_bounds(epochs)
        case "loguniform":
            return log_uniform(values)
        case "custom" | "customfixed":
            if any(b <= a for a, b in zip([0.0, *values[:-1]], values, strict=True)):
                raise ValueError("interval points rise from above 0")
            return [0.0, *(x / (here if kind == "custom" else 1.0) for x in values), INF]
        case "fixeduniform":
            return balanced(int(values[0]), here / values[1])
        case "meanrate":
            return mean_rate(int(values[0]), epochs, trunk)
        case "mixtureuniform":
            return mixture_uniform(int(values[0]), epochs, trunk)
        case "old":
            return old(int(values[0]), epochs, trunk)
        case "balanced":
            return balanced(int(values[0]), values[1] if len(values) > 1 else 1.0)
        case "quadrature" | "quadrature2":
            return quadrature(int(values[0]), values[1] if len(values) > 1 else 1.0, epochs, trunk, kind == "quadrature2")
    raise ValueError(f"no interval type is called {kind}")
