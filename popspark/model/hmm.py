"""Forward and backward passes of a conditional sampling distribution over blocks of loci."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np

#: Steps whose emissions and states are held at once; of the others, only the state at a block's beginning is kept.
BLOCK = 256
#: The slot of counts that hold for every trunk haplotype alike.
EVERY = -2


@dataclass(frozen=True)
class Tables:
    """initial[s], stay[s] (no recombination), move[s, d] (recombination), emit[s, b, a]: natural logarithms; deme[s].

    For each state, stay and the row of move add up to one. b is the trunk's allele, a the additional haplotype's. A state
    is an interval of time and a present deme, from which the haplotype that is joined comes.
    """

    initial: np.ndarray
    stay: np.ndarray
    move: np.ndarray
    emit: np.ndarray
    deme: np.ndarray

    def shares(self, demes: list[int]) -> np.ndarray:
        """ln of each trunk haplotype's share of a state's deme [s, h]; minus infinity in other demes. A haplotype that is
        in the trunk several times is listed so often."""
        own = self.deme[:, None] == np.asarray(demes)[None]
        with np.errstate(divide="ignore"):
            return np.where(own, -np.log(np.maximum(own.sum(1, keepdims=True), 1)), -np.inf)


@dataclass(frozen=True)
class Cells:
    """Pair counts of one CSD on one contig, in order of steps: at how many loci of a step the additional haplotype shows a
    while trunk haplotype ``slot`` shows b. Steps without counts tell nothing."""

    step: np.ndarray
    slot: np.ndarray
    a: np.ndarray
    b: np.ndarray
    n: np.ndarray
    n_steps: int
    n_slots: int
    n_alleles: int

    @staticmethod
    def of(step: np.ndarray, slot: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, n_steps: int, n_slots: int, n_alleles: int) -> Cells:
        order = np.argsort(step, kind="stable")
        return Cells(step[order], slot[order], a[order], b[order], n[order], n_steps, n_slots, n_alleles)

    @staticmethod
    def dense(counts: np.ndarray) -> Cells:
        """From counts[step, slot, a, b]."""
        step, slot, a, b = (x.ravel() for x in np.indices(counts.shape))
        return Cells.of(step, slot, a, b, counts.ravel(), counts.shape[0], counts.shape[1], counts.shape[2])

    def block(self, low: int, high: int) -> np.ndarray:
        """counts[step, slot, a, b] of the steps from low to high."""
        at = slice(*np.searchsorted(self.step, [low, high]))
        out = np.zeros((high - low, self.n_slots, self.n_alleles, self.n_alleles))
        every = self.slot[at] == EVERY
        for some, slots in ((~every, self.slot[at]), (every, None)):
            step, a, b, n = (x[at][some] for x in (self.step, self.a, self.b, self.n))
            if slots is None:
                still = np.zeros((high - low, self.n_alleles, self.n_alleles))
                np.add.at(still, (step - low, a, b), n)
                out += still[:, None]
            else:
                np.add.at(out, (step - low, slots[some], a, b), n)
        return out


#: The code of an allele that is missing.
MISSING = 254


@dataclass(frozen=True)
class Mixtures:
    """Loci at which a slot's allele is missing: the additional haplotype shows ``allele`` while the slot's alleles have the
    probabilities ``share`` [locus, b]."""

    step: np.ndarray
    slot: np.ndarray
    allele: np.ndarray
    share: np.ndarray

    def emitted(self, low: int, high: int, tables: Tables, n_slots: int) -> np.ndarray:
        """ln of what they emit [step, s, slot], in the steps from low to high."""
        at = slice(*np.searchsorted(self.step, [low, high]))
        out = np.zeros((high - low, len(tables.emit), n_slots))
        with np.errstate(divide="ignore"):
            seen = np.log(np.einsum("nb,sbn->ns", self.share[at], np.exp(tables.emit)[:, :, self.allele[at]]))
        np.add.at(out.transpose(0, 2, 1), (self.step[at] - low, self.slot[at]), np.maximum(seen, -1e300))
        return out


@dataclass(frozen=True)
class CodeCells(Cells):
    """Pair counts that are made block by block from alleles: those of the additional haplotype, own[site], and of each slot's,
    others[slot, site], at sites of which step[site] is the step; pairs with a missing one do not count. The arrays of Cells hold
    the loci that are alike for all, and mixtures what is put in for missing alleles, by one set of tables."""

    site_step: np.ndarray
    own: np.ndarray
    others: np.ndarray
    mixtures: Mixtures | None = None

    @staticmethod
    def at(site_step: np.ndarray, codes: np.ndarray, still: np.ndarray, n_steps: int, n_alleles: int) -> CodeCells:
        """From codes[member, site], the additional haplotype first, and still, rows of step, allele and number of loci."""
        still = still[np.argsort(still[:, 0], kind="stable")]
        return CodeCells(still[:, 0], np.full(len(still), EVERY), still[:, 1], still[:, 1], still[:, 2], n_steps, len(codes) - 1, n_alleles, site_step, codes[0], codes[1:])

    def block(self, low: int, high: int) -> np.ndarray:
        out = super().block(low, high)
        at = slice(*np.searchsorted(self.site_step, [low, high]))
        step, own, others = self.site_step[at] - low, self.own[at], self.others[:, at]
        slot, site = np.nonzero((own != MISSING)[None] & (others != MISSING))
        np.add.at(out, (step[site], slot, own[site], others[slot, site]), 1)
        return out

    def imputed(self, demes: np.ndarray, n_demes: int, tables_of: Callable[[tuple[tuple[int, ...], int]], Tables], stationary: np.ndarray) -> CodeCells:
        """With mixtures for the trunk's missing alleles. At a locus, the haplotype that lacks one is seen as an additional one of
        its deme whose trunk are those that show theirs: the shares of alleles in each deme go through the first state's
        law and emissions. Without any, the stationary distribution holds. Where the additional haplotype's own is missing,
        the locus tells nothing."""
        slot, site = np.nonzero((self.own != MISSING)[None] & (self.others == MISSING))
        known: dict[tuple, np.ndarray] = {}
        shares = np.empty((len(slot), self.n_alleles))
        for i, (h, at) in enumerate(zip(slot.tolist(), site.tolist(), strict=True)):
            shown = self.others[:, at] != MISSING
            counts = np.zeros((n_demes, self.n_alleles), int)
            np.add.at(counts, (demes[shown], self.others[shown, at]), 1)
            key = (counts.tobytes(), int(demes[h]))
            if key not in known:
                known[key] = stationary if not shown.any() else imputed_alleles(counts, tables_of((tuple(counts.sum(1).tolist()), int(demes[h]))))
            shares[i] = known[key]
        order = np.argsort(self.site_step[site], kind="stable")
        return replace(self, mixtures=Mixtures(self.site_step[site][order], slot[order], self.own[site][order].astype(np.int64), shares[order]))

    def expanded(self) -> Cells:
        """The same as plain cells, a row for each site and slot."""
        slot = np.repeat(np.arange(self.n_slots), len(self.site_step))
        columns = [(np.tile(self.site_step, self.n_slots), self.step), (slot, self.slot), (np.tile(self.own, self.n_slots), self.a), (self.others.ravel(), self.b), (np.ones(len(slot), np.int64), self.n)]
        return Cells.of(*(np.concatenate(c).astype(np.int64) for c in columns), self.n_steps, self.n_slots, self.n_alleles)


def imputed_alleles(counts: np.ndarray, tables: Tables) -> np.ndarray:
    """The probability of each allele of a haplotype, given counts[deme, allele] of a trunk of which these are the tables."""
    with np.errstate(invalid="ignore"):
        shares = np.nan_to_num(counts / counts.sum(1, keepdims=True))
    found = np.einsum("s,sf,sfb->b", np.exp(tables.initial), shares[tables.deme], np.exp(tables.emit))
    return found / found.sum()


def stationary(matrix: np.ndarray) -> np.ndarray | None:
    """The distribution that a mutation matrix leaves as it is; None where there are several."""
    n = len(matrix)
    system = np.concatenate([matrix.T - np.eye(n), np.ones((1, n))])
    found, _, rank, _ = np.linalg.lstsq(system, np.append(np.zeros(n), 1.0), rcond=None)
    return np.maximum(found, 0.0) if rank == n else None


def log_sum(x: np.ndarray, axis: int | tuple[int, ...] | None = None) -> np.ndarray:
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.squeeze(np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top, axis=axis)


def emissions(counts: np.ndarray, tables: Tables) -> np.ndarray:
    """e[t, s, h] = sum over alleles of counts[t, h, a, b] * emit[s, b, a]."""
    t, h, k, _ = counts.shape
    table = np.maximum(tables.emit, -1e300).transpose(0, 2, 1).reshape(len(tables.emit), k * k)
    return (counts.reshape(t * h, k * k) @ table.T).reshape(t, h, -1).transpose(0, 2, 1)


def emitted_by(cells: Cells, low: int, high: int, tables: Tables) -> tuple[np.ndarray, np.ndarray]:
    """(counts, ln emissions) of the steps from low to high, mixtures for missing alleles included."""
    counts = cells.block(low, high)
    e = emissions(counts, tables)
    if isinstance(cells, CodeCells) and cells.mixtures is not None:
        e = e + cells.mixtures.emitted(low, high, tables, cells.n_slots)
    return counts, e


class _Underflow(Exception):
    """The states of a step are too far apart for numbers that are not logarithms."""


class _Chain:
    """The chain in plain numbers: each step's states are scaled to add up to one, and the logarithm of the scale is kept.

    Steps are gone through in blocks, so that memory does not grow with a contig but for one state a block.
    """

    def __init__(self, cells: Cells, tables: Tables, share: np.ndarray, low: int = 0, high: int | None = None):
        self.cells, self.tables, self.low, self.high = cells, tables, low, cells.n_steps if high is None else high
        self.initial, self.stay, self.move, self.share = (np.exp(x) for x in (tables.initial, tables.stay, tables.move, share))
        self.stay = self.stay[:, None]

    def emitted(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(counts, emissions over the step's greatest one, logarithms of these)."""
        counts, e = emitted_by(self.cells, low, high, self.tables)
        top = np.where(self.share > 0, e, -np.inf).max((1, 2))
        if not np.isfinite(top).all():
            raise _Underflow
        return counts, np.exp(np.minimum(e - top[:, None, None], 0.0)), top

    def step(self, state: np.ndarray | None, emitted: np.ndarray) -> tuple[np.ndarray, float]:
        """The next state, and the logarithm of the scale that it had. A step costs S*S + S*H: haplotypes are summed out before
        states are crossed."""
        before = self.initial[:, None] * self.share if state is None else self.stay * state + (state.sum(1) @ self.move)[:, None] * self.share
        after = before * emitted
        scale = float(after.sum())
        if not 1e-290 < scale < np.inf:
            raise _Underflow
        return after / scale, np.log(scale)

    def promised(self, following: np.ndarray) -> np.ndarray:
        """What a state promises, from the scaled product of what the following one promises and emits."""
        return self.stay * following + (self.move @ (self.share * following).sum(1))[:, None]

    def scaled(self, promise: np.ndarray, emitted: np.ndarray, scale: float) -> np.ndarray:
        """Promise times emission over the step's scale."""
        out = promise * emitted / np.exp(scale)
        if not np.isfinite(out).all():
            raise _Underflow
        return out

    def posterior(self, state: np.ndarray, promise: np.ndarray) -> np.ndarray:
        return state * promise

    def nothing(self, shape: tuple[int, ...]) -> np.ndarray:
        """A promise of 1 from each state."""
        return np.ones(shape)

    def counted(self, states: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected stays [s], moves [s, d] and moves to the same haplotype and state [s], summed over steps."""
        stay = np.einsum("tsh,tsh->s", states, following) * self.stay[:, 0]
        move = states.sum(2).T @ np.einsum("sh,tsh->ts", self.share, following) * self.move
        return stay, move, np.einsum("tsh,sh,tsh->s", states, self.share, following) * np.diag(self.move)

    def blocks(self) -> list[tuple[int, int]]:
        return [(low, min(low + BLOCK, self.high)) for low in range(self.low, self.high, BLOCK)]

    def forward(self, state: np.ndarray | None = None) -> tuple[float, list[np.ndarray | None]]:
        """The ln likelihood, and the state before each block. ``state`` is that of a chain of which this one is the
        continuation; its own last one is kept."""
        total, kept = 0.0, []
        for low, high in self.blocks():
            kept.append(state)
            _, emitted, top = self.emitted(low, high)
            for t in range(high - low):
                state, scale = self.step(state, emitted[t])
                total += scale
            total += float(top.sum())
        self.state = state
        return total, kept

    def backward(self, kept: list[np.ndarray | None], after: _Chain | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks from the last to the first: (first step, counts, posteriors, states and what follows them). The last two
        leave out the chain's last step. ``after``, if given, is the chain that continues this one and has been gone through; the
        step onto its first one is ``edge`` then, and happens by its tables."""
        following, self.edge = None, None
        for (low, high), state in zip(self.blocks()[::-1], kept[::-1], strict=True):
            counts, emitted, _ = self.emitted(low, high)
            states, scales = np.empty_like(emitted), np.empty(high - low)
            for t in range(high - low):
                state, scales[t] = self.step(state, emitted[t])
                states[t] = state
            posterior, next_ = np.empty_like(emitted), np.empty_like(emitted)
            last = following is None
            for t in range(high - low - 1, -1, -1):
                if following is not None:
                    promise = self.promised(following)
                    next_[t] = following
                elif after is not None:
                    promise = after.promised(after.following)
                    self.edge = states[t][None], after.following[None]
                else:
                    promise = self.nothing(emitted[t].shape)
                posterior[t] = self.posterior(states[t], promise)
                following = self.scaled(promise, emitted[t], scales[t])
            self.following = following
            n = high - low - last
            yield low, counts, posterior, states[:n], next_[:n]


class _LogChain(_Chain):
    """The same chain in logarithms, block by block as well, for states that are too far apart for plain numbers."""

    def __init__(self, cells: Cells, tables: Tables, share: np.ndarray, low: int = 0, high: int | None = None):
        self.cells, self.tables, self.share, self.low, self.high = cells, tables, share, low, cells.n_steps if high is None else high
        self.initial, self.stay, self.move = tables.initial, tables.stay[:, None], tables.move

    def emitted(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return *emitted_by(self.cells, low, high, self.tables), np.zeros(high - low)

    def step(self, state: np.ndarray | None, emitted: np.ndarray) -> tuple[np.ndarray, float]:
        if state is None:
            after = self.initial[:, None] + self.share + emitted
        else:
            arrive = log_sum(self.move + log_sum(state, 1)[:, None], 0)
            after = np.logaddexp(self.stay + state, arrive[:, None] + self.share) + emitted
        scale = float(log_sum(after))
        # Where no state can be, nothing is left to scale.
        return (after - scale if np.isfinite(scale) else after), scale

    def promised(self, following: np.ndarray) -> np.ndarray:
        return np.logaddexp(self.stay + following, log_sum(self.move + log_sum(self.share + following, 1)[None], 1)[:, None])

    def scaled(self, promise: np.ndarray, emitted: np.ndarray, scale: float) -> np.ndarray:
        return promise + emitted - (scale if np.isfinite(scale) else 0.0)

    def posterior(self, state: np.ndarray, promise: np.ndarray) -> np.ndarray:
        return np.exp(state + promise)

    def nothing(self, shape: tuple[int, ...]) -> np.ndarray:
        return np.zeros(shape)

    def counted(self, states: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stay = np.exp(states + self.stay + following).sum((0, 2))
        move = np.exp(log_sum(states, 2)[:, :, None] + self.move + log_sum(self.share + following, 2)[:, None]).sum(0)
        return stay, move, np.exp(states + self.share + np.diag(self.move)[:, None] + following).sum((0, 2))


def _in_plain_or_logs(run: Callable, cells: Cells, tables: Tables, share: np.ndarray) -> object:
    """What ``run`` makes of the chain in plain numbers or, where these do not reach, in logarithms."""
    try:
        return run(_Chain(cells, tables, share))
    except _Underflow:
        return run(_LogChain(cells, tables, share))


def loglik(cells: Cells, tables: Tables, share: np.ndarray) -> float:
    """The ln likelihood of a CSD."""
    return _in_plain_or_logs(lambda chain: chain.forward()[0], cells, tables, share) if cells.n_steps else 0.0


#: Numbers that a block of emissions may have where several particles are evaluated at once.
WIDE = 1 << 21


def logliks(cells: Cells, tables: list[Tables], shares: list[np.ndarray]) -> list[float]:
    """The ln likelihood of a CSD under each of several tables. Those of one shape go through the chain side by side, so that
    a step costs about as much for sixteen of them as for one; one that plain numbers do not reach goes by itself."""
    if not cells.n_steps:
        return [0.0] * len(tables)
    alike: dict[tuple, list[int]] = {}
    for i, t in enumerate(tables):
        alike.setdefault((len(t.initial), shares[i].shape[1]), []).append(i)
    out = [0.0] * len(tables)
    for (s, h), places in alike.items():
        width = max(1, WIDE // (BLOCK * s * max(h, 1)))
        for at in range(0, len(places), width):
            part = places[at : at + width]
            for i, value in zip(part, _abreast(cells, [tables[i] for i in part], np.stack([shares[i] for i in part])), strict=True):
                out[i] = loglik(cells, tables[i], shares[i]) if np.isnan(value) else float(value)
    return out


def _abreast(cells: Cells, tables: list[Tables], share: np.ndarray) -> np.ndarray:
    """The ln likelihood under tables of one shape [p]; nan where plain numbers do not reach."""
    initial, stay, move = (np.exp(np.stack([getattr(t, x) for t in tables])) for x in ("initial", "stay", "move"))
    share, stay = np.exp(share), stay[:, :, None]
    total, state = np.zeros(len(tables)), None
    with np.errstate(invalid="ignore", divide="ignore", over="ignore"):
        for low in range(0, cells.n_steps, BLOCK):
            counts = cells.block(low, min(low + BLOCK, cells.n_steps))
            e = np.stack([emissions(counts, t) for t in tables], 1)
            top = np.where(share > 0, e, -np.inf).max((2, 3))
            e = np.exp(np.minimum(e - top[:, :, None, None], 0.0))
            for t in range(len(e)):
                before = initial[:, :, None] * share if state is None else stay * state + (state.sum(2)[:, None] @ move).transpose(0, 2, 1) * share
                state = before * e[t]
                scale = state.sum((1, 2))
                scale = np.where((scale > 1e-290) & np.isfinite(top[t]), scale, np.nan)
                state /= scale[:, None, None]
                total += np.log(scale)
            total += top.sum(0)
    return total


Stats = tuple[np.ndarray, ...]


def expected(cells: Cells, tables: Tables, share: np.ndarray) -> tuple[float, Stats]:
    """(ln likelihood, (initial[s], stay[s], move[s, d], emit[s, b, a], own[s])), expected counts over the whole chunk.

    own are those of move that recombine into the same state and the same haplotype.
    """
    s, k = len(tables.initial), cells.n_alleles

    def run(chain: _Chain) -> tuple[float, Stats]:
        initial, stay, move, emit, own = np.zeros(s), np.zeros(s), np.zeros((s, s)), np.zeros((s, k * k)), np.zeros(s)
        total, kept = chain.forward()
        if np.isfinite(total):
            for low, counts, posterior, states, following in chain.backward(kept):
                for whole, part in zip((stay, move, own), chain.counted(states, following), strict=True):
                    whole += part
                emit += posterior.transpose(1, 0, 2).reshape(s, -1) @ counts.reshape(-1, k * k)
                if low == 0:
                    initial = posterior[0].sum(1)
        return total, (initial, stay, move, emit.reshape(s, k, k).transpose(0, 2, 1), own)

    if not cells.n_steps:
        return 0.0, (np.zeros(s), np.zeros(s), np.zeros((s, s)), np.zeros((s, k, k)), np.zeros(s))
    return _in_plain_or_logs(run, cells, tables, share)


def rated(cells: Cells, tables: dict[int, Tables], runs: np.ndarray, share: np.ndarray, with_stats: bool = True) -> tuple[float, dict[int, Stats]]:
    """As ``expected`` where rates change along the chain: (ln likelihood, expected counts by rate). runs are rows (first step,
    rate), in order and from step 0 on; the step onto a locus happens by that locus's tables."""
    s, k = len(next(iter(tables.values())).initial), cells.n_alleles
    ends = np.append(runs[1:, 0], cells.n_steps).tolist()

    def run(kind: type[_Chain]) -> tuple[float, dict[int, Stats]]:
        chains = [(int(r), kind(cells, tables[int(r)], share, int(low), int(high))) for (low, r), high in zip(runs.tolist(), ends, strict=True) if high > low]
        total, state, kept = 0.0, None, []
        for _, chain in chains:
            value, blocks = chain.forward(state)
            total, state = total + value, chain.state
            kept.append(blocks)
        found = {r: (np.zeros(s), np.zeros(s), np.zeros((s, s)), np.zeros((s, k * k)), np.zeros(s)) for r, _ in chains}
        after, rate_after = None, -1

        def add(r: int, parts: tuple[np.ndarray, np.ndarray, np.ndarray]) -> None:
            for whole, part in zip((found[r][1], found[r][2], found[r][4]), parts, strict=True):
                whole += part

        if with_stats and np.isfinite(total):
            for (r, chain), blocks in zip(chains[::-1], kept[::-1], strict=True):
                for low, counts, posterior, states, following in chain.backward(blocks, after):
                    add(r, chain.counted(states, following))
                    found[r][3][:] += posterior.transpose(1, 0, 2).reshape(s, -1) @ counts.reshape(-1, k * k)
                    if low == 0:
                        found[r][0][:] = posterior[0].sum(1)
                if after is not None:
                    add(rate_after, after.counted(*chain.edge))
                after, rate_after = chain, r
        return total, {r: (a, b, c, d.reshape(s, k, k).transpose(0, 2, 1), e) for r, (a, b, c, d, e) in found.items()}

    if not cells.n_steps:
        return 0.0, {}
    try:
        return run(_Chain)
    except _Underflow:
        return run(_LogChain)


def decoded(cells: Cells, tables: Tables, share: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The posterior probability of each state at each step, summed over haplotypes: blocks (first step, [t, s]), the last first."""
    if cells.n_steps:
        yield from _in_plain_or_logs(lambda chain: [(low, posterior.sum(2)) for low, _, posterior, _, _ in chain.backward(chain.forward()[1])], cells, tables, share)


def forward(counts: np.ndarray, tables: Tables, share: np.ndarray) -> tuple[np.ndarray, float]:
    """(F[t, s, h], ln likelihood) of counts[t, h, a, b], in logarithms and as a whole: for short chains, and to compare with."""
    e = emissions(counts, tables)
    out = np.empty_like(e)
    out[0] = tables.initial[:, None] + share + e[0]
    for t in range(1, len(e)):
        arrive = log_sum(tables.move + log_sum(out[t - 1], 1)[:, None], 0)
        out[t] = np.logaddexp(tables.stay[:, None] + out[t - 1], arrive[:, None] + share) + e[t]
    return out, float(log_sum(out[-1]))


def backward(counts: np.ndarray, tables: Tables, share: np.ndarray) -> np.ndarray:
    """B[t, s, h]: ln probability of what follows step t."""
    e = emissions(counts, tables)
    out = np.zeros_like(e)
    for t in range(len(e) - 2, -1, -1):
        ahead = out[t + 1] + e[t + 1]
        out[t] = np.logaddexp(tables.stay[:, None] + ahead, log_sum(tables.move + log_sum(share + ahead, 1)[None], 1)[:, None])
    return out


def expected_in_logs(counts: np.ndarray, tables: Tables, share: np.ndarray) -> tuple[float, tuple[np.ndarray, ...]]:
    """As ``expected``, in logarithms, a step at a time."""
    f, total = forward(counts, tables, share)
    b = backward(counts, tables, share)
    e = emissions(counts, tables)
    with np.errstate(invalid="ignore"):
        posterior = np.nan_to_num(np.exp(f + b - total))
        ahead = (b + e)[1:]
        stay = np.nan_to_num(np.exp(f[:-1] + tables.stay[:, None] + ahead - total)).sum((0, 2))
        move, own = np.zeros_like(tables.move), np.zeros(len(stay))
        for x, y in zip(f[:-1], ahead, strict=True):
            own += np.nan_to_num(np.exp(x + np.diag(tables.move)[:, None] + share + y - total)).sum(1)
            move += np.nan_to_num(np.exp(log_sum(x, 1)[:, None] + tables.move + log_sum(share + y, 1)[None] - total))
    return total, (posterior[0].sum(1), stay, move, np.einsum("tsh,thab->sba", posterior, counts), own)


def gain(stats: tuple[np.ndarray, ...], tables: Tables, trunk: tuple[int, ...] | None = None, kind: str = "transition") -> float:
    """The expected log-likelihood of the counts under other tables, but for what does not depend on them.

    ``kind``: transition tells recombinations from their absence; lineage does not tell one into the same haplotype from
    none (``trunk`` has the number of haplotypes in each deme); marginal takes the states only, without transitions.
    """
    initial, stay, move, emit, own = stats
    log = lambda x: np.maximum(x, -1e6)
    first, seen = float((initial * log(tables.initial)).sum()), float((emit * log(tables.emit)).sum())
    match kind:
        case "transition":
            return first + seen + float((stay * log(tables.stay)).sum() + (move * log(tables.move)).sum())
        case "lineage":
            with np.errstate(divide="ignore"):
                alone = -np.log(np.asarray(trunk, float))[tables.deme]
            same = np.logaddexp(tables.stay, np.where(np.isfinite(alone), np.diag(tables.move) + alone, -np.inf))
            return first + seen + float(((stay + own) * log(same)).sum() + ((move - np.diag(own)) * log(tables.move)).sum())
        case "marginal":
            visits = initial + stay + move.sum(0)
            return seen + float((visits * log(tables.initial)).sum())
    raise ValueError(f"no objective is called {kind}")


def doubled(tables: Tables, between: np.ndarray) -> Tables:
    """Tables of two steps at once, where between[s] is the ln emission of the step in the middle, equal for all haplotypes.

    What neither step moves has stayed; all else has moved, as a haplotype is drawn anew with every move.
    """
    stay, move = tables.stay, tables.move
    through = log_sum(move[:, :, None] + between[None, :, None] + move[None], 1)
    once = np.logaddexp((stay + between)[:, None] + move, move + (between + stay)[None])
    return Tables(tables.initial, stay + between + stay, np.logaddexp(once, through), tables.emit, tables.deme)


def jump_tables(tables: Tables, between: np.ndarray, highest: int) -> list[Tables]:
    """Tables of 1, 2, 4, ... steps, so that a run of steps without segregating sites takes as many jumps as its length has bits."""
    out = [tables]
    for _ in range(highest):
        out.append(doubled(out[-1], between))
    return out


@dataclass(frozen=True)
class StillCells(Cells):
    """Cells in which a step without counts has ``still`` loci at which all haplotypes show ``allele``, but for the steps in
    ``missing`` (rows of first step and number), which tell nothing."""

    still: float
    allele: int
    missing: np.ndarray

    def block(self, low: int, high: int) -> np.ndarray:
        out = super().block(low, high)
        quiet = np.ones(high - low, bool)
        at = slice(*np.searchsorted(self.step, [low, high]))
        quiet[self.step[at] - low] = False
        quiet &= ~_within(np.arange(low, high), self.missing)
        out[quiet, :, self.allele, self.allele] += self.still
        return out


NO_RUNS = np.empty((0, 2), np.int64)


def _within(steps: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each step is in one of the runs (first step, number), which are in order and apart."""
    if not len(runs):
        return np.zeros(len(steps), bool)
    k = np.searchsorted(runs[:, 0], steps, "right") - 1
    return (k >= 0) & (steps < runs[k, 0] + runs[k, 1])


class _Skips(_Chain):
    """The chain over the steps that are visited: those with counts, the first and the last one, and others that are asked
    for. Between two of them, runs of still or of missing steps are jumped over by powers of two.

    A jump has the same form as a step (what has stayed, and what has moved), so it counts its expected stays and moves like
    one; in the end, those of each jump are shared out among the two jumps of half its length that it is made of, and so on
    down to single steps.
    """

    def __init__(self, cells: StillCells, tables: Tables, share: np.ndarray, visits: np.ndarray):
        self.places = np.unique(np.concatenate([cells.step, visits, [0, cells.n_steps - 1]])).astype(np.int64)
        seen = np.isin(self.places, cells.step)
        quiet = ~seen & ~_within(self.places, cells.missing)
        every = np.flatnonzero(quiet)
        columns = [np.concatenate([np.searchsorted(self.places, cells.step), every])]
        columns += [np.concatenate([x, np.full(len(every), v)]) for x, v in ((cells.slot, EVERY), (cells.a, cells.allele), (cells.b, cells.allele), (cells.n, cells.still))]
        super().__init__(Cells.of(*columns, len(self.places), cells.n_slots, cells.n_alleles), tables, share)
        self.missing, self.ends = cells.missing, cells.missing.sum(1)
        between = np.maximum(tables.emit[:, cells.allele, cells.allele], -1e300) * cells.still
        highest = int(np.diff(self.places).max(initial=1)).bit_length() - 1
        #: By kind (still, missing): what a step in between emits, and its tables of 1, 2, 4, ... steps.
        self.between = [between, np.zeros_like(between)]
        self.levels = [jump_tables(tables, b, highest) for b in self.between]
        self.jumps = []
        for levels in self.levels:
            top = [max(float(t.stay.max()), float(t.move.max())) for t in levels]
            self.jumps.append([(np.exp(t.stay - c)[:, None], np.exp(t.move - c), c) for t, c in zip(levels, top, strict=True)])
        self.quiet = [(float(b.max()), np.exp(b - b.max())[:, None]) for b in self.between]
        size = len(between)
        self.found = [[(np.zeros(size), np.zeros((size, size))) for _ in levels] for levels in self.levels]
        self.passed = [np.zeros(size), np.zeros(size)]

    def run(self, i: int) -> list[tuple[int, int]]:
        """From the i-th place to the next: (kind, power of two) of each jump. All steps that a jump ends with or goes over are
        of its kind, but for the last one, which is visited."""
        x, y = int(self.places[i]), int(self.places[i + 1])
        pieces, at = [], x
        m = int(np.searchsorted(self.ends, x + 1, "right"))
        while m < len(self.missing) and self.missing[m, 0] < y:
            low, high = max(int(self.missing[m, 0]), at + 1), min(int(self.ends[m]), y)
            if high > low:
                if low > at + 1:
                    pieces.append((0, low - 1 - at))
                pieces.append((1, high - low))
                at = high - 1
            m += 1
        if y > at + 1:
            pieces.append((0, y - 1 - at))
        # The step onto the visited place goes with the last piece.
        kind, n = pieces.pop() if pieces else (0, 0)
        return [(kind, k) for kind, n in [*pieces, (kind, n + 1)] for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]

    def jumped(self, state: np.ndarray, run: list[tuple[int, int]], emitted: np.ndarray) -> tuple[np.ndarray, float, list[tuple[np.ndarray, np.ndarray, float]]]:
        """The state at the next place, ln of its scale, and for each jump the state before and behind it and its scale."""
        total, trail = 0.0, []
        for i, (kind, k) in enumerate(run):
            stay, move, c = self.jumps[kind][k]
            top, e = (0.0, emitted) if i == len(run) - 1 else self.quiet[kind]
            after = (stay * state + (state.sum(1) @ move)[:, None] * self.share) * e
            scale = float(after.sum())
            if not 1e-290 < scale < np.inf:
                raise _Underflow
            trail.append((state, after / scale, scale))
            state = after / scale
            total += np.log(scale) + c + top
        return state, total, trail

    def forward(self) -> tuple[float, list[np.ndarray | None]]:
        total, state, kept = 0.0, None, []
        for low, high in self.blocks():
            kept.append(state)
            _, emitted, top = self.emitted(low, high)
            for t in range(high - low):
                if state is None:
                    state, scale = self.step(None, emitted[t])
                else:
                    state, scale, _ = self.jumped(state, self.run(low + t - 1), emitted[t])
                total += scale
            total += float(top.sum())
        return total, kept

    def backward_through(self, kept: list[np.ndarray | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Blocks from the last to the first: (first place, counts, posteriors). Jumps are counted on the way."""
        promise = None
        for (low, high), state in zip(self.blocks()[::-1], kept[::-1], strict=True):
            counts, emitted, _ = self.emitted(low, high)
            trails, states = [], np.empty_like(emitted)
            for t in range(high - low):
                if state is None:
                    state, _ = self.step(None, emitted[t])
                    trails.append([])
                else:
                    state, _, trail = self.jumped(state, self.run(low + t - 1), emitted[t])
                    trails.append(trail)
                states[t] = state
            posterior = np.empty_like(emitted)
            for t in range(high - low - 1, -1, -1):
                promise = np.ones_like(states[t]) if promise is None else promise
                posterior[t] = states[t] * promise
                run = self.run(low + t - 1) if trails[t] else []
                for i in range(len(run) - 1, -1, -1):
                    (kind, k), (before, after, scale) = run[i], trails[t][i]
                    e = emitted[t] if i == len(run) - 1 else self.quiet[kind][1]
                    if i < len(run) - 1:
                        self.passed[kind] += (after * promise).sum(1)
                    following = promise * e / scale
                    stay, move, _ = self.jumps[kind][k]
                    arrive = (self.share * following).sum(1)
                    stays, moves = self.found[kind][k]
                    stays += (before * following).sum(1) * stay[:, 0]
                    moves += np.outer(before.sum(1), arrive) * move
                    promise = stay * following + (move @ arrive)[:, None]
                    if not np.isfinite(promise).all():
                        raise _Underflow
            yield low, counts, posterior

    def shared_out(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """(stays, moves) of single steps, and how often each kind of step in between was in each state."""
        stay, move = np.zeros(len(self.initial)), np.zeros_like(self.move)
        for kind, (levels, found) in enumerate(zip(self.levels, self.found, strict=True)):
            between = self.between[kind]
            for k in range(len(levels) - 1, 0, -1):
                half, whole, (stays, moves) = levels[k - 1], levels[k], found[k]
                less_stays, less_moves = found[k - 1]
                less_stays += 2 * stays
                self.passed[kind] += stays
                with np.errstate(invalid="ignore"):
                    part = lambda x: np.where(moves > 0, moves * np.exp(np.minimum(x - whole.move, 0.0)), 0.0)  # noqa: B023, E731
                    early = part(half.move + (between + half.stay)[None])
                    late = part((half.stay + between)[:, None] + half.move)
                    for m in range(len(between)):
                        through = part(half.move[:, m : m + 1] + between[m] + half.move[m : m + 1])
                        less_moves[:, m] += through.sum(1)
                        less_moves[m] += through.sum(0)
                        self.passed[kind][m] += through.sum()
                less_moves += early + late
                less_stays += late.sum(1) + early.sum(0)
                self.passed[kind] += late.sum(1) + early.sum(0)
            stay += found[0][0]
            move += found[0][1]
        return stay, move, self.passed


def _still(cells: Cells, still: float, allele: int, missing: np.ndarray | None) -> StillCells:
    if isinstance(cells, CodeCells):
        cells = cells.expanded()
    runs = NO_RUNS if missing is None else np.asarray(missing, np.int64).reshape(-1, 2)
    return StillCells(cells.step, cells.slot, cells.a, cells.b, cells.n, cells.n_steps, cells.n_slots, cells.n_alleles, still, allele, runs)


def skipping(cells: Cells, tables: Tables, share: np.ndarray, still: float = 1.0, allele: int = 0, missing: np.ndarray | None = None) -> float:
    """The ln likelihood where every step without counts has ``still`` loci at which all haplotypes show ``allele``, or tells
    nothing if it is in one of the ``missing`` runs (first step, number).

    Only steps with counts are visited; the gaps between them are jumped by powers of two, so the time goes with the number
    of segregating sites and the logarithm of the gaps, not with the contig's length.
    """
    if not cells.n_steps:
        return 0.0
    whole = _still(cells, still, allele, missing)
    try:
        return _Skips(whole, tables, share, np.empty(0, np.int64)).forward()[0]
    except _Underflow:
        return loglik(whole, tables, share)


def skipping_expected(cells: Cells, tables: Tables, share: np.ndarray, still: float = 1.0, allele: int = 0, missing: np.ndarray | None = None) -> tuple[float, Stats]:
    """As ``expected`` for the loci that ``skipping`` takes, visiting the same steps: what happens inside jumps is counted on
    the jumps' tables."""
    if not cells.n_steps:
        return expected(cells, tables, share)
    whole = _still(cells, still, allele, missing)
    s, k = len(tables.initial), cells.n_alleles
    try:
        chain = _Skips(whole, tables, share, np.empty(0, np.int64))
        total, kept = chain.forward()
        emit, initial = np.zeros((s, k * k)), np.zeros(s)
        for low, counts, posterior in chain.backward_through(kept):
            emit += posterior.transpose(1, 0, 2).reshape(s, -1) @ counts.reshape(-1, k * k)
            if low == 0:
                initial = posterior[0].sum(1)
        stay, move, passed = chain.shared_out()
        emit = emit.reshape(s, k, k).transpose(0, 2, 1)
        emit[:, allele, allele] += passed[0] * still
        # A move to the same haplotype and state has the same two ends as a stay, whichever the haplotype is.
        slots = np.exp(-share.max(1))
        with np.errstate(divide="ignore", invalid="ignore"):
            own = np.where(stay > 0, stay * np.exp(np.diag(tables.move) - tables.stay) / slots, 0.0)
        return total, (initial, stay, move, emit, own)
    except _Underflow:
        return expected(whole, tables, share)


def skipping_decoded(cells: Cells, tables: Tables, share: np.ndarray, places: np.ndarray, still: float = 1.0, allele: int = 0, missing: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The posterior probability of each state at some steps (in order), which are visited beside those with counts: blocks
    (steps, [step, s]), the last first."""
    if not cells.n_steps:
        return
    whole = _still(cells, still, allele, missing)
    places = places[(places >= 0) & (places < cells.n_steps)]
    try:
        chain = _Skips(whole, tables, share, places)
        held = [(chain.places[low : low + len(p)], p.sum(2)) for low, _, p in chain.backward_through(chain.forward()[1])]
    except _Underflow:
        held = ((np.arange(low, low + len(p)), p) for low, p in decoded(whole, tables, share))
    for steps, p in held:
        wanted = np.isin(steps, places)
        if wanted.any():
            yield steps[wanted], p[wanted]
