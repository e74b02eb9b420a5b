"""Transition and emission tables in closed form, for demographies whose rates are constant between boundaries.

In a piece of time with one epoch and one hidden interval, a lineage of deme d migrates and is absorbed by a constant matrix
G = migration - diag(absorption). With G's eigenvalues and projections, all that the tables need are integrals of products of
exponentials, so there are no time steps. After the last boundary only what does not decay is left.
"""

from __future__ import annotations

import numpy as np

from popspark.model.coalescent import Trunk, pieces, table_of
from popspark.model.hmm import Tables
from popspark.sources.models import Epoch, Params

#: An eigenvalue that counts as 0, and how well the eigenvectors have to give the matrix back.
ZERO, EXACT = 1e-12, 1e-9


def spectrum(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values[k], projections[k, d, e]) of a matrix, which is the sum of values[k] * projections[k]. One that has no full set
    of eigenvectors is an error."""
    values, vectors = np.linalg.eig(g.astype(complex))
    try:
        left = np.linalg.inv(vectors)
    except np.linalg.LinAlgError:
        left = np.full_like(vectors, np.nan)
    parts = np.einsum("dk,ke->kde", vectors, left)
    if not np.abs(np.einsum("k,kde->de", values, parts) - g).max() <= EXACT * max(1.0, abs(g).max()) or np.abs(vectors).max() * np.abs(left).max() > 1e9:
        raise ValueError("a migration and absorption matrix cannot be diagonalized")
    return np.where(abs(values) < ZERO, 0, values), parts


def grown(x: np.ndarray, w: float) -> np.ndarray:
    """The integral of exp(x * t) over t from 0 to w. Over all time, what grows or stays counts as 0: no mass is absorbed there."""
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        if w == float("inf"):
            return np.where(x.real < 0, -1 / x, 0)
        y = x * w
        # Near 0 the quotient cancels; the series has 1e-17 of error there.
        return w * np.where(abs(y) < 1e-3, 1 + y / 2 * (1 + y / 3 * (1 + y / 4 * (1 + y / 5))), np.expm1(y) / np.where(y == 0, 1, y))


def decayed(x: np.ndarray, w: float) -> np.ndarray:
    """exp(x * w); after all time, 1 where x is 0 and 0 elsewhere."""
    return np.where(x == 0, 1, 0).astype(complex) if w == float("inf") else np.exp(x * w)


def both(alpha: np.ndarray, beta: np.ndarray, w: float) -> np.ndarray:
    """The integral of exp(alpha * u + beta * (w - u)) over u from 0 to w."""
    return np.exp(beta * w) * grown(alpha - beta, w)


def held(trunk: Trunk, a: float, b: float, sizes: np.ndarray, migration: np.ndarray) -> np.ndarray:
    """The trunk's lineages [present deme, ancient deme] that a piece of time is given: those that the cake style takes, or the
    mean of its ends where they migrate."""
    far = min(b, a + 100 * (sizes.max() + 1 / max(float(migration.max(initial=0)), 1e-3) * (len(sizes) > 1)))
    if trunk.style == "migratingethan":
        start = trunk.n.copy()
        trunk.migrated(far - a, sizes, migration)
        return (start + trunk.n) / 2
    left = trunk.piece(a, b, sizes, migration)
    return (left(a, 0.0) + left(far, 0.0)) / 2


def spectral_tables(epochs: tuple[Epoch, ...], bounds: list[float], trunk: np.ndarray, deme: int, params: Params, loci: int = 1, style: str = "migratingethan", one_event: bool = True, cake: str = "average") -> Tables:
    """As ``coalescent.tables``, by eigenvectors. Growth is an error, and so is a matrix that cannot be diagonalized."""
    if any(any(e.growth) for e in epochs if e.pulse is None):
        raise ValueError("the spectral core takes no growth")
    present, states = len(trunk), len(trunk) * (len(bounds) - 1)
    rho, thetas = params.rho * loci, params.in_intervals(len(bounds) - 1)
    # How fast each kind of change goes on in units of the mutation rate.
    kinds = np.array([0.0, 1.0]) if one_event else 1 - np.linalg.eigvals(params.matrix.astype(complex))
    left = Trunk(trunk, style, cake)
    line: list = []
    for part in pieces(epochs, bounds, left):
        if isinstance(part, np.ndarray):
            line.append(part)
            continue
        a, b, k, e = part
        sizes, migration = np.array(e.sizes, float), np.array(e.migration, float)
        n = held(left, a, b, sizes, migration)
        now = n.sum(0)
        spread = (n / np.where(now > 0, now, 1)).T
        values, parts = spectrum(migration - np.diag(now / sizes))
        line.append((a, b - a, k, values, parts, np.diag(now / sizes) @ spread))

    # law[i][d, state]: what absorbs a lineage of deme d from the i-th piece on; ends[i] is what it is behind that piece.
    law = np.zeros((len(epochs[-1].sizes), states), complex)
    laws: list = []
    for part in reversed(line):
        laws.append(law)
        if isinstance(part, np.ndarray):
            law = part @ law
            continue
        _, w, k, values, parts, rates = part
        hit = np.zeros((len(rates), states), complex)
        hit[:, k * present : (k + 1) * present] = rates
        law = np.einsum("k,kde,es->ds", decayed(values, w), parts, law) + np.einsum("k,kde,es->ds", grown(values, w), parts, hit)
    laws.reverse()

    together = np.zeros(len(epochs[0].sizes), complex)
    together[next(i for i, p in enumerate(epochs[0].partition) if deme in p)] = 1
    alone = together
    initial, stay, reco = np.zeros(states, complex), np.zeros(states, complex), np.zeros((states, states), complex)
    mass = np.zeros((len(kinds), states), complex)
    for part, ahead in zip(line, laws, strict=True):
        if isinstance(part, np.ndarray):
            together, alone = together @ part, alone @ part
            continue
        a, w, k, values, parts, rates = part
        at = slice(k * present, (k + 1) * present)
        initial[at] += np.einsum("d,kde,k,ep->p", alone, parts, grown(values, w), rates)
        stay[at] += np.einsum("d,kde,k,ep->p", together, parts, grown(values - rho, w), rates)
        for m, c in enumerate(kinds):
            mass[m, at] += np.exp(-c * params.mutated(a, bounds)) * np.einsum("d,kde,k,ep->p", alone, parts, grown(values - c * thetas[k], w), rates)
        # The law inside the piece, at x before its end, is the sum over k of exp(values[k] * x) * shape[k], and a constant.
        hit = np.zeros((len(rates), states), complex)
        hit[:, at] = rates
        open_ = values != 0
        over = np.where(open_, 1 / np.where(open_, values, 1), 0)
        constant = -np.einsum("k,kde,es->ds", over, parts, hit)
        shape = np.concatenate([np.einsum("kde,es->kds", parts, ahead) + np.einsum("k,kde,es->kds", over, parts, hit), constant[None]])
        beta = np.append(values, 0)
        seen = np.einsum("d,kde->ke", together, parts)
        if w == float("inf"):
            # Behind the last boundary nothing is ahead, so the law is the constant.
            weight = np.einsum("ke,k->e", seen, grown(values - rho, w))
            reco += rho * np.einsum("e,es,er->sr", weight, constant, constant)
        else:
            x = both((values - rho)[:, None, None], beta[None, :, None] + beta[None, None], w)
            weight = np.einsum("je,jkl->ekl", seen, x)
            for d in range(len(rates)):
                reco += rho * shape[:, d].T @ weight[d] @ shape[:, d]
        together = np.einsum("d,kde,k->e", together, parts, decayed(values - rho, w))
        alone = np.einsum("d,kde,k->e", alone, parts, decayed(values, w))
    if one_event:
        still, whole = mass[1].real, mass[0].real
        emit = still[:, None, None] * np.eye(len(params.matrix)) + (whole - still)[:, None, None] * params.matrix
    else:
        _, q = spectrum(params.matrix.astype(float))
        emit = np.einsum("ms,mba->sba", mass, q).real
    return table_of(initial.real, stay.real, reco.real, emit, present)
